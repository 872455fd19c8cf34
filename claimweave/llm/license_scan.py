"""License scans: an exact set-containment join of license templates with text blocks.

Templates and blocks are sets of words. Words are ordered by how often they
occur in the corpus, rarest first. A block that holds at least ``overlap`` of a
template's ``n`` words shares one of the template's first ``n - overlap + 1``
words, at one of its own first ``size - overlap + 1``; candidates from that
prefix join pass a length and a position filter and are then counted exactly.
Words outside all templates can't add to an overlap, so blocks leave them out.

Blocks are overlapping word windows, line breaks being blanks, and the text as a
whole for base phrases, whose words must all be there (overlap ``n``) and are
then found in sequence. A template matches where a run of at most twice its
length holds the overlap and all of its names, and no other variant's word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part of a template's words that a run of words must hold.
CONTAINMENT = 0.8

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License statements and the method's labels for them.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
)

#: Words of a template that must be there whatever else is.
NAMES = frozenset("mit apache gnu lesser affero mozilla unencumbered cc sa nc creative commons cc0 2 3 4".split())
#: Words that make another license of one with the name.
VARIANTS = {"gnu": ("lesser", "affero"), "cc": ("sa", "nc", "nd"), "creative": ("sharealike", "noncommercial", "noderivatives", "noderivs")}
#: Words after a match that may still name a variant.
AFTER = 2

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# letter case doesn't move a word's ends, so words can be counted before it is folded; a list of what
# words consist of is several times as fast to match as one of what they don't
_WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _patterns(templates, phrases, containment: float) -> list[dict]:
    out = [{"unit": "run", "label": label, "words": text.split()} for text, label in templates]
    out += [{"unit": "text", "label": label, "words": text.split()} for text, label in phrases.items()]
    for k, p in enumerate(out):
        p["id"], p["set"] = k, sorted(set(p["words"]))
        p["n"] = len(p["set"])
        p["names"] = sorted(NAMES.intersection(p["set"])) if p["unit"] == "run" else []
        p["variants"] = sorted({v for w in p["names"] for v in VARIANTS.get(w, ())} - set(p["set"]))
        p["run"] = 2 * len(p["words"])
        p["overlap"] = p["n"] if p["unit"] == "text" else -(-int(round(containment * 100)) * p["n"] // 100)
    return out


def _folded(text: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that have each word, rarest first; ties by name. The order saves work only, so letters outside A-Z may be folded too."""
    known = F.array(*map(F.lit, vocabulary))
    words = docs.select(F.explode(F.array_intersect(F.split(F.lower(F.col("text").cast("string")), _OTHER), known)).alias("w"))
    seen = {r.w: r.n for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each template word
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _block(number: Column, found: Column, places: Column) -> Column:
    return F.struct(number.alias("block"), F.array_distinct(found).alias("tokens"), places.alias("places"))


def _most_held(places: Column, tokens_of: Column, names: Column, variants: Column, run: Column, overlap: Column) -> Column:
    """The most words of a template that a run holds which meets the rules; null if none does."""
    own = F.filter(places, lambda x: F.array_contains(tokens_of, x["w"]))
    other = F.filter(places, lambda x: F.array_contains(variants, x["w"]))

    def held(a: Column, b: Column) -> Column:
        words = F.array_distinct(F.transform(F.filter(own, lambda x: x["i"].between(a["i"], b["i"])), lambda x: x["w"]))
        clean = ~F.exists(other, lambda x: x["i"].between(a["i"], b["i"] + AFTER))
        return F.when(clean & (F.size(words) >= overlap) & (F.size(F.array_except(names, words)) == 0), F.size(words))

    ends = lambda a: F.filter(own, lambda b: (b["i"] >= a["i"] + overlap - 1) & (b["i"] < a["i"] + run))
    return F.array_max(F.transform(own, lambda a: F.array_max(F.transform(ends(a), lambda b: held(a, b)))))


def license_matches(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    ``score`` is the largest containment among matched templates; a base phrase
    counts as 1, no match as 0. Where the words stand in lines doesn't matter. A
    null or empty text has no words. Every row gives a row: repeated rows
    repeated ones, rows with a null or shared doc_id are looked at each on its
    own; an empty table gives an empty result. Texts of any length are looked at
    whole. Other columns of ``docs``, whatever their names, are left alone.
    """
    spark = docs.sparkSession
    patterns = _patterns(templates, phrases, containment)
    vocabulary = sorted({w for p in patterns for w in (*p["set"], *p["variants"])})
    rank = {w: k for k, w in enumerate(word_order(docs, vocabulary))}
    index, starters = [], set()
    for p in patterns:
        ordered = sorted(p["set"], key=rank.__getitem__)
        for i, w in enumerate(ordered[: p["n"] - p["overlap"] + 1]):
            index.append((w, p["id"], i))
            starters.add(w)
    index_table = spark.createDataFrame(index, "token string, pattern int, i int")
    pattern_table = spark.createDataFrame([(p["id"], p["unit"], p["label"], p["words"], p["set"], p["names"], p["variants"], p["run"], p["n"], p["overlap"]) for p in patterns], "pattern int, unit string, label string, words array<string>, tokens_of array<string>, names array<string>, variants array<string>, run int, n int, overlap int")
    prefixes = F.broadcast(index_table.join(pattern_table, "pattern"))  # as many rows as the templates have words, at most

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    phrase_words = sorted({w for p in patterns if p["unit"] == "text" for w in p["words"]})
    ranks = F.create_map(*(x for w, k in rank.items() for x in (F.lit(w), F.lit(k))))
    # any run, and what may follow it, lies whole in one of these windows
    stride = max((p["run"] for p in patterns if p["unit"] == "run"), default=1) + AFTER

    low, all_words = F.col("low"), F.col("words")
    in_window = lambda k: F.filter(F.transform(F.slice(all_words, k * stride + 1, 2 * stride), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary))
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_words), F.lit(1)) - 1) / stride).cast("int")), lambda k: F.struct(k.alias("k"), in_window(k).alias("places")))
    windows = F.filter(windows, lambda b: F.exists(b["places"], lambda x: x["w"].isin(sorted(starters))))
    run_blocks = F.transform(windows, lambda b: _block(b["k"], F.transform(b["places"], lambda x: x["w"]), b["places"]))
    places = F.filter(F.transform(all_words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(phrase_words))
    text_block = F.transform(F.array(places), lambda ps: _block(F.lit(-1), F.transform(ps, lambda x: x["w"]), ps))
    # the prefix filter on whole documents: one of the first words of a template must be in the text
    gate = F.lit(False)
    for w in sorted(starters):
        gate = gate | F.contains(low, F.lit(w))
    scanned = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__text"))
        # all that is about a row comes from one read of it, so a number tells rows apart
        .withColumn("h", F.monotonically_increasing_id())
        # letters outside A-Z that lower() folds as well can only let more texts through the gate
        .select("doc_id", "h", F.regexp_count("__text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), F.lower("__text").alias("low"), "__text")
        .select("doc_id", "h", "n_words", F.when(gate, F.filter(F.split(_folded(F.col("__text")), _OTHER), lambda w: w != "")).alias("words"))
        .select("doc_id", "h", "n_words", F.when(all_words.isNotNull(), F.concat(run_blocks, text_block)).alias("blocks"))
    )
    block = scanned.select("doc_id", "h", "n_words", F.explode_outer("blocks").alias("b"))
    ordered = F.transform(F.array_sort(F.transform(F.col("b.tokens"), lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"])
    token = block.select("doc_id", "h", "n_words", "b.block", "b.places", ordered.alias("tokens")).select("doc_id", "h", "n_words", "block", "places", "tokens", F.posexplode_outer("tokens").alias("j", "token"))
    size = F.size("tokens")
    unit = F.when(F.col("block") < 0, "text").otherwise("run")
    candidate = (
        (F.col("unit") == unit)
        & (size >= F.col("overlap"))
        & (F.col("j") < size - F.col("overlap") + 1)
        & (F.least("i", "j") + 1 + F.least(F.col("n") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("overlap"))
    )
    shared = F.when(candidate, F.size(F.array_intersect("tokens", "tokens_of")))
    joined = token.join(prefixes, "token", "left").withColumn("shared", shared).withColumn("holds", F.coalesce(F.col("shared") >= F.col("overlap"), F.lit(False)))
    is_text = F.col("unit") == "text"
    held = _most_held(*(F.col(c) for c in ("places", "tokens_of", "names", "variants", "run", "overlap")))

    def sequence(ps: Column, words: Column) -> Column:
        """Where the words stand one after another: neighbours in ``places`` that are neighbours in the text."""
        starts = F.transform(ps, lambda x, k: F.when(F.forall(F.sequence(F.lit(0), F.size(words) - 1), lambda d: F.coalesce((F.get(ps, k + d)["w"] == F.get(words, d)) & (F.get(ps, k + d)["i"] == x["i"] + d), F.lit(False))), x["i"]))
        return F.filter(starts, lambda s: s.isNotNull())

    found = joined.select(
        "doc_id", "h", "n_words", "label", "pattern",
        F.when(F.col("holds") & is_text, sequence(F.col("places"), F.col("words"))).alias("starts"),
        F.when(F.col("holds") & ~is_text, held / F.col("n")).alias("part"),
    )
    base = F.size("starts") > 0
    grouped = found.groupBy("doc_id", "h", "n_words").agg(
        # a set, as a phrase is found once for each of its words in the prefix
        F.aggregate(F.collect_set(F.when(base, F.struct("pattern", "starts"))), F.lit(0), lambda n, p: n + F.size(p["starts"])).cast("long").alias("n_base"),
        F.min(F.when(base, F.array_min("starts"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.array_max("starts"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base"),
        F.array_sort(F.collect_set(F.when(base | F.col("part").isNotNull(), F.col("label")))).alias("all"),
        F.max(F.when(base, F.lit(1.0)).otherwise(F.col("part"))).alias("part"),
    )
    return grouped.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"), F.coalesce("part", F.lit(0.0)).alias("score"))
