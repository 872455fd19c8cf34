"""Phrases that a page's lines hold in pieces: words split over tokens or misread by a letter."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Digits that are read for letters.
CONFUSED = {"0": "o", "1": "i", "5": "s", "8": "b"}
#: Tokens that one word may be split into, letters of a word from which one may be wrong, and how far a phrase may reach down a page.
MOST_PIECES, LONG_WORD, MOST_SPAN = 4, 5, 0.14


def _folded(word: str) -> str:
    """A word's letters in lower case, digits that look like letters read as these."""
    return "".join(c for c in (CONFUSED.get(c, c) for c in word.lower()) if "a" <= c <= "z")


def _passing(word: str) -> set[str]:
    """The texts that are read as a word: itself, and if it's long also those with one letter exchanged, or one more or fewer at the end."""
    if len(word) < LONG_WORD:
        return {word}
    return {word, word[:-1]} | {word + c for c in ascii_lowercase} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ascii_lowercase}


#: How tokens of a page follow each other.
_DOWN = ("y0", "x0", "ord", "k")


def _tokens_of(lines: DataFrame, text: str = "text") -> DataFrame:
    """page, token (folded as a word is), ord, k, x0, y0, x1, y1: lines are dealt by page first, as their words are more data."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.translate(F.col(text), ascii_uppercase + "".join(CONFUSED), ascii_lowercase + "".join(CONFUSED.values()))
    words = lines.repartition(tasks, "page").select("page", F.posexplode(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).alias("k", "word"), "ord", "x0", "y0", "x1", "y1")
    return words.select("page", F.translate("word", digits, "").alias("token"), "ord", "k", "x0", "y0", "x1", "y1")


def numbered_tokens(lines: DataFrame, text: str = "text") -> DataFrame:
    """page, pos (from 0, down the page and then to the right), token (folded), x0, y0, x1, y1 of its line."""
    place = F.row_number().over(Window.partitionBy("page").orderBy(*_DOWN)) - 1
    return _tokens_of(lines, text).select("page", place.alias("pos"), "token", "x0", "y0", "x1", "y1")


def recovered_phrases(lines: DataFrame, phrases: dict[str, list[str]], most_span: float = MOST_SPAN) -> DataFrame:
    """page, family, phrase, tokens, quality, x0, y0, x1, y1 of every phrase that a page's lines hold, once.

    ``lines``: page, ord, text, x0, y0, x1, y1 in parts of the page; lines with
    equal corners go by ord. Each word of a phrase is the first one to four
    tokens in a row that make it up, or all but one letter of it if it has five
    or more; the next word begins where the last one ended. A phrase may not
    reach further down than ``most_span``, and the first start that fits wins.
    Quality is 1 less 0.05 for each token that is no word of the phrase, 0.75 at least.

    Every text that passes for a word is listed, so words are found by one
    equi-join of what a token makes up with its followers, and kept as a table;
    phrases by as many equi-joins on page and place as the longest one has
    words, for all phrases together.
    """
    spark = lines.sparkSession
    tokens = numbered_tokens(lines)
    wanted = [(family, phrase, [_folded(w) for w in phrase.split()]) for family, own in sorted(phrases.items()) for phrase in own]
    words = sorted({w for _, _, own in wanted for w in own})
    after = Window.partitionBy("page").orderBy(*_DOWN)
    piece = F.struct("token", "x0", "y0", "x1", "y1")
    row = _tokens_of(lines).select("page", (F.row_number().over(after) - 1).alias("pos"), piece.alias("p0"), *(F.lead(piece, k).over(after).alias(f"p{k}") for k in range(1, MOST_PIECES)))
    made = [F.concat(*(F.col(f"p{k}.token") for k in range(n))) for n in range(1, MOST_PIECES + 1)]  # null beyond the page's end
    row = row.select("page", "pos", F.array(*made).alias("made"), F.array(*(f"p{k}" for k in range(MOST_PIECES))).alias("ahead"))
    forms = spark.createDataFrame([(form, w) for w in words for form in sorted(_passing(w))], "made string, word string")
    found = row.select("page", "pos", "ahead", F.posexplode("made").alias("n", "made")).join(F.broadcast(forms), "made")  # the phrases' words, a parameter
    hops = found.groupBy("page", "word", "pos").agg((F.min("n") + 1).alias("n"), F.min_by("ahead", "n").alias("ahead")).select("page", "word", "pos", "n", F.slice("ahead", F.lit(1), F.col("n")).alias("used"))
    hops = staged(hops, "words") if words else hops
    steps = spark.createDataFrame([(k, family, phrase, step, own[step], len(own)) for k, (family, phrase, own) in enumerate(wanted) for step in range(len(own))], "k int, family string, phrase string, step int, word string, size int")
    chain, out = None, None
    for step in range(max((len(own) for _, _, own in wanted), default=0)):
        here = hops.join(F.broadcast(steps.filter(F.col("step") == step).drop("step")), "word")  # the phrases' words, a parameter
        if chain is None:
            chain = here.select("page", "k", "family", "phrase", "size", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("pos"), "used")
        else:
            chain = chain.withColumnRenamed("used", "before").join(here.select("page", "k", "pos", "n", "used"), ["page", "k", "pos"]).select("page", "k", "family", "phrase", "size", "start", (F.col("pos") + F.col("n")).alias("pos"), F.concat("before", "used").alias("used"))
        done = chain.filter(F.col("size") == step + 1)
        out = done if out is None else out.unionByName(done)
    if out is None:
        return tokens.limit(0).select("page", F.lit("").alias("family"), F.lit("").alias("phrase"), F.array("token").alias("tokens"), F.lit(1.0).alias("quality"), "x0", "y0", "x1", "y1")
    box = {"x0": F.array_min("used.x0"), "y0": F.array_min("used.y0"), "x1": F.array_max("used.x1"), "y1": F.array_max("used.y1")}
    first = out.withColumns(box).filter(F.col("y1") - F.col("y0") <= most_span).groupBy("page", "k", "family", "phrase").agg(F.min_by(F.struct("used", *box), "start").alias("f"))
    of_phrase = F.create_map(*(x for k, (_, _, own) in enumerate(wanted) for x in (F.lit(k), F.array(*map(F.lit, own)))))
    strange = F.size(F.filter("f.used.token", lambda t: ~F.array_contains(F.element_at(of_phrase, F.col("k")), t)))
    return first.select("page", "family", "phrase", F.col("f.used.token").alias("tokens"), F.greatest(F.lit(0.75), 1 - 0.05 * strange).alias("quality"), *(f"f.{c}" for c in box))
