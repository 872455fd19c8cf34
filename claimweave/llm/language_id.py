"""Language identification by mixtures: EM over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import words

#: Hashed character trigrams of the model; with the languages they bound its size.
GRAMS = 1 << 16
#: Pseudo-count of every trigram in every language.
SMOOTHING = 0.5
#: EM steps for one set of languages.
STEPS = 12
#: Gain in log-likelihood that one more language must bring, times log(trigrams) / 2.
PENALTY = 12.0
#: Documents whose main language has a smaller share are rejected by ``accepted``.
LEAST_SHARE = 0.4
#: Languages up to which a task keeps all probabilities (so many times GRAMS numbers), not only those of trigrams that were seen.
DENSE_LANGUAGES = 128
#: Entries (a trigram seen in a language) up to which the model is sent to the tasks; a larger one is joined to the documents by trigram.
MODEL_ENTRIES = 1 << 24
#: Copies of a joined model, so that a frequent trigram goes to as many tasks.
SPREAD = 64
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


class Sparse:
    """Probabilities (languages x some trigrams) of which most are the smoothing of their language alone.

    It stands for the matrix in products from both sides; rows are taken from
    it as an ordinary matrix.
    """

    __array_ufunc__ = None

    def __init__(self, total: np.ndarray, language: np.ndarray, column: np.ndarray, count: np.ndarray, columns: int) -> None:
        self.base, self.columns = SMOOTHING / total, columns
        self.language, self.column, self.more = language, column, count / total[language]

    def __len__(self) -> int:
        return len(self.base)

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return self.base * weights.sum() + np.bincount(self.language, self.more * weights[self.column], len(self.base))

    def __rmatmul__(self, share: np.ndarray) -> np.ndarray:
        return share @ self.base + np.bincount(self.column, self.more * share[self.language], self.columns)

    def __getitem__(self, rows: list[int]) -> np.ndarray:
        out = np.repeat(self.base[rows][:, None], self.columns, 1)
        for k, row in enumerate(rows):
            own = self.language == row
            out[k, self.column[own]] += self.more[own]
        return out

    def alone(self, n: np.ndarray) -> np.ndarray:
        """The log-likelihood under each language by itself."""
        low = np.log(self.base)
        rise = np.log(self.base[self.language] + self.more) - low[self.language]
        return low * n.sum() + np.bincount(self.language, rise * n[self.column], len(low))


@dataclass
class Model:
    """Trigram counts of languages: entries in order of trigram, or their table where they are too many."""

    languages: list[str]
    total: np.ndarray  # each language's counts, with smoothing
    start: np.ndarray | None = None  # of each trigram its first entry; GRAMS + 1 numbers
    language: np.ndarray | None = None
    count: np.ndarray | None = None
    table: DataFrame | None = None  # code (language * GRAMS + trigram), n

    def dense(self) -> np.ndarray:
        """All probabilities: languages x GRAMS."""
        counts = np.full((len(self.languages), GRAMS), SMOOTHING)
        counts[self.language, np.repeat(np.arange(GRAMS), np.diff(self.start))] += self.count
        return counts / self.total[:, None]

    def at(self, grams: np.ndarray) -> Sparse:
        """The probabilities of some trigrams."""
        many = self.start[grams + 1] - self.start[grams]
        first = np.cumsum(many) - many
        entry = np.repeat(self.start[grams] - first, many) + np.arange(int(many.sum()))
        return Sparse(self.total, self.language[entry], np.repeat(np.arange(len(grams)), many), self.count[entry], len(grams))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _trigrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram around every letter byte, blanks for all else; and each row's first one."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    letter = _LETTER[raw]
    b = np.where(letter, raw, 32).astype(np.uint32)
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    filled = np.diff(offs) > 0
    before[offs[:-1][filled]] = 32
    after[offs[1:][filled] - 1] = 32
    at = np.flatnonzero(letter)
    code = ((before[at] << 16) | (b[at] << 8) | after[at]) * np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64), np.searchsorted(at, offs)


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams, in order, and how often each occurs."""
    if len(grams) < GRAMS // 8:
        return np.unique(grams, return_counts=True)
    n = np.bincount(grams, minlength=GRAMS)
    at = np.flatnonzero(n)
    return at, n[at]


def train(docs: DataFrame, model_entries: int = MODEL_ENTRIES) -> Model | None:
    """Trigram counts per language, over all documents outside fold 1 with a language and a text.

    All values of ``lang`` are learned, each from all of its documents. Names
    and totals (two numbers for each) come to the driver; the counts do too if
    they are no more than ``model_entries``, and stay a table otherwise. None
    if there is nothing to learn.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 1)).select(F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            of_row = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, raw, offs in words.chunks(batch.column(1)):
                grams, first = _trigrams(raw, offs)
                lang = np.repeat(of_row[lo:hi], np.diff(first))
                code, n = np.unique((lang * GRAMS + grams)[lang >= 0], return_counts=True)
                code, at = np.unique(np.concatenate([held[0], code]), return_inverse=True)
                held = code, np.bincount(at, np.concatenate([held[1], n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["code", "n"])

    table = staged(rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "trigrams")
    total = np.full(len(languages), SMOOTHING * GRAMS)
    for r in table.groupBy(F.floor(F.col("code") / GRAMS).alias("k")).agg(F.sum("n").alias("n")).collect():
        total[r.k] += r.n
    if table.count() > model_entries:
        return Model(languages, total, table=table)
    entries = table.toArrow()
    code, n = entries.column("code").to_numpy(), entries.column("n").to_numpy().astype(float)
    order = np.lexsort((code // GRAMS, code % GRAMS))
    code, n = code[order], n[order]
    return Model(languages, total, np.searchsorted(code % GRAMS, np.arange(GRAMS + 1)), code // GRAMS, n)


def mixture(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows of ``p``) behind trigrams seen ``n`` times, and the log-likelihood."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(steps):
        share = share * (p @ (n / (share @ p))) / total
    return share, float(n @ np.log(share @ p))


def grown(p, alone: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """(language, proportion), largest first: the set with the best penalised likelihood, grown one by one.

    ``p`` has the probabilities (languages x trigrams seen ``n`` times) and ``alone`` the log-likelihood under each language.
    """
    first = int(np.argmax(alone))
    best, chosen = float(alone[first]), [(first, 1.0)]
    if len(alone) > 1:
        whole, _ = mixture(p, n)
        order = [first, *(k for k in np.argsort(-whole, kind="stable").tolist() if k != first)]
        price = penalty * math.log(max(2.0, n.sum())) / 2
        for size in range(2, len(order) + 1):
            share, fit = mixture(p[order[:size]], n)
            if fit - best <= price:
                break
            best, chosen = fit, sorted(zip(order[:size], share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return chosen


def languages_of(probability: np.ndarray, log_p: np.ndarray, gram: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """``grown`` with all probabilities (languages x GRAMS) and their logarithms at hand."""
    return grown(probability[:, gram], log_p[:, gram] @ n, n, penalty)


def _named(languages: list[str], chosen: list[tuple[int, float]]) -> tuple[str, float, str]:
    return languages[chosen[0][0]], min(1.0, chosen[0][1]), ",".join(f"{languages[i]}:{s:.4f}" for i, s in chosen)


def _low(text: Column) -> Column:
    """The text that is looked at: null if it has no letter."""
    return F.when(text.rlike("\\p{L}"), F.lower(text))


def _joined(base: DataFrame, model: Model, penalty: float) -> DataFrame:
    """``identify`` with the model's table joined to the documents' trigrams; a task holds those of one document at a time."""
    tagged = staged(base.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sent = base.sparkSession.sparkContext.broadcast((model.languages, model.total))

    def grams(batches):
        for batch in batches:
            for lo, hi, raw, offs in words.chunks(batch.column(1)):
                found, first = _trigrams(raw, offs)
                row = batch.column(0).slice(lo, hi - lo).to_numpy()
                each = [_counts(found[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, [len(g) for g, _ in each])), pa.array(np.concatenate([g for g, _ in each])), pa.array(np.concatenate([n for _, n in each]))], ["__row", "gram", "n"])

    def solve(table: pa.Table) -> pa.Table:
        languages, total = sent.value
        n = table.column("n").to_numpy().astype(float)
        language, count = table.column("languages").combine_chunks(), table.column("counts").combine_chunks()
        many = language.value_lengths().fill_null(0).to_numpy()
        p = Sparse(total, language.flatten().to_numpy(), np.repeat(np.arange(len(n)), many), count.flatten().to_numpy().astype(float), len(n))
        name, score, mix = _named(languages, grown(p, p.alone(n), n, penalty))
        return pa.table({"__row": table.column("__row").slice(0, 1), "lang_pred": [name], "score": [score], "lang_mix": [mix]})

    known = tagged.select("__row", _low(F.col("text")).alias("low")).filter("low IS NOT NULL")
    seen = known.mapInArrow(grams, "__row long, gram long, n long").withColumn("copy", F.pmod("__row", F.lit(SPREAD)))
    by_gram = model.table.groupBy((F.col("code") % GRAMS).alias("gram")).agg(F.collect_list(F.struct(F.floor(F.col("code") / GRAMS).cast("long").alias("l"), "n")).alias("own"))
    by_gram = by_gram.select("gram", F.col("own.l").alias("languages"), F.col("own.n").alias("counts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("copy"))
    solved = seen.join(by_gram, ["gram", "copy"], "left").select("__row", "gram", "n", "languages", "counts").groupBy("__row").applyInArrow(solve, "__row long, lang_pred string, score double, lang_mix string")
    return tagged.join(solved, "__row", "left").select(*base.columns, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lang_mix", F.lit("")).alias("lang_mix"))


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and lang_mix added (columns of these names are replaced).

    ``score`` is the main language's share of the text, ``lang_mix`` all chosen
    languages with theirs. A text that is null or has no letter, and every text
    if nothing was learned, is ``und`` with score 0. Only the text is looked at,
    and all of it, however long. Of equally likely languages the first by name is
    taken. However many languages there are, all take part: their model is sent
    to the tasks or, if it is too large for that, joined by trigram.
    """
    base = docs.drop("lang_pred", "score", "lang_mix")
    if model is not None and model.table is not None:
        return _joined(base, model, penalty)
    given = base.withColumn("__low", _low(F.col("text")))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    width = len(base.columns)

    def run(batches):
        model = sent.value
        probability = model.dense() if model and len(model.languages) <= DENSE_LANGUAGES else None
        log_p = np.log(probability) if probability is not None else None
        for batch in batches:
            low = batch.column(width)
            named, score, mix = [], [], []
            known = low.is_valid().to_pylist()
            for lo, hi, raw, offs in words.chunks(low):
                grams, first = _trigrams(raw, offs)
                for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if model is None or not known[lo + k]:
                        named.append(UNDETERMINED)
                        score.append(0.0)
                        mix.append("")
                        continue
                    at, seen = _counts(grams[x:y])
                    if probability is not None:
                        chosen = languages_of(probability, log_p, at, seen.astype(float), penalty)
                    else:
                        sparse = model.at(at)
                        chosen = grown(sparse, sparse.alone(seen.astype(float)), seen.astype(float), penalty)
                    for out, x in zip((named, score, mix), _named(model.languages, chosen), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], [*batch.schema.names[:width], "lang_pred", "score", "lang_mix"]
            )

    schema = base.schema.add("lang_pred", "string").add("score", "double").add("lang_mix", "string") if base.columns else None
    return given.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix of every document; learned from the same table's other folds.

    A null doc_id is in no fold: not held out, and nothing is learned from it. So
    where no document can be learned from (all ids null, say) all are ``und``.
    Empty tables give an empty result; repeated rows repeated ones. Columns other
    than doc_id, text and lang are left alone, whatever their names.
    """
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_mix")


def accepted(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` that have a language, and a main one: ``und`` and texts of many languages go.

    All columns stay as they are, also ones named lang_pred, score or lang_mix.
    Each row is judged on its own text; its doc_id may be null or repeated.
    """
    ours = [c for c in ("lang_pred", "score", "lang_mix") if c in docs.columns]
    kept = docs.withColumnsRenamed({c: f"__{c}" for c in ours})
    found = identify(kept, train(docs)).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_share))
    return found.select(*kept.columns).withColumnsRenamed({f"__{c}": c for c in ours})
