"""Quality rules: base limits, and robust outliers by minimum-covariance-determinant estimates.

Transformed statistics of the documents of one language and source are taken
as one cloud. From three starts (spreads alone; correlations of squashed
values; spatial signs) concentration steps lead to subsets of three quarters
of the rows with ever smaller covariance determinants: distances by the present
estimate, the nearest rows, their mean and covariance, and again. The start
with the least determinant goes on until it settles. The scatter is made
consistent for a normal cloud and regularised by the resolution of each
statistic. Each step is two small aggregations over all rows (a quantile and
moments), so a group of any size is never in one task. A group's estimate is
drawn towards its language's, and that to the one of all rows, the more the
fewer rows it has. Documents whose squared Mahalanobis distance is beyond a
chi-square quantile are rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import words

#: Base limits, as the contract has them.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Part of a group's rows that the estimate rests on.
CORE = 0.75
#: Concentration steps from every start, and those that follow from the best one unless it settles before.
FIRST_STEPS, MORE_STEPS = 2, 8
#: Change of the logarithm of the determinant at which an estimate has settled.
SETTLED = 1e-3
#: Rows of its own at which a group weighs as much as its parent in its estimate.
PRIOR_ROWS = 200
#: Part of the documents of a normal cloud that stay.
KEPT_PART = 0.999
#: Keys up to which the table of estimates is broadcast (about 500 bytes each).
BROADCAST_KEYS = 20_000
#: Parts of a key's rows beyond that, each of which is joined in a task of its own.
SALTS = 64
#: Resolution of each transformed statistic: its square is added to the scatter, so statistics that are the same almost everywhere don't make it singular.
FLOORS = (0.08, 0.3, 0.2, 0.25, 0.08, 0.1)

_P = len(FLOORS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[33:65] = _MARK[91:97] = _MARK[123:127] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SPACE = " \t\n\x0b\x0c\r"


def _repeated(hashes: np.ndarray) -> int:
    """Words that lie in 3-word windows found twice or more."""
    runs = words.joined(hashes, 3)
    if len(runs) < 2:
        return 0
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for d in range(3):
        covered[d : d + len(often)] |= often
    return int(covered.sum())


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null: '') and the statistics of every whole text (null: none)."""

    def run(batches):
        for batch in batches:
            text = batch.column(3)
            for lo, hi, raw, offs in words.chunks(text):
                starts, ends, first = words.word_spans(raw, offs, words.SPACED)
                hashes = words.hash_words(raw, starts, ends, fold=False)
                character = (raw & 0xC0) != 0x80
                inside = words.SPACED[raw]
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[offs]) for x in (character & inside, _SYMBOL[raw], _UPPER[raw], _MARK[raw])]
                lines = [_line_counts(x or "") for x in text.slice(lo, hi - lo).to_pylist()]
                repeat = [_repeated(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                columns = [np.diff(first), sums[0], sums[1], [x[1] for x in lines], repeat, [x[0] for x in lines], sums[2], sums[3]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "lang", "source", *_STATS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATS))


def _features() -> list[Column]:
    """Word length, symbols, repetition, equal lines, capitals and marks; shares by square roots or logarithms."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return [F.log(chars / n), F.log1p(100 * F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_upper") / chars), F.sqrt(F.col("n_marks") / chars)]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def chi_square(x: float, p: int) -> float:
    """Distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, p) < q:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, p) < q else (low, (low + high) / 2)
    return high


def consistency(core: float, p: int = _P) -> float:
    """What the covariance of the nearest ``core`` of a normal cloud is multiplied by to be that of all of it."""
    return core / chi_square(chi_square_quantile(core, p), p + 2)


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_UPPER_AT = np.triu_indices(_P)


def _full(upper) -> np.ndarray:
    out = np.zeros((_P, _P))
    out[_UPPER_AT] = upper
    return np.triu(out) + np.triu(out, 1).T


def _for_distance(scatter: np.ndarray) -> list[float]:
    """The inverse's upper triangle, doubled off the diagonal."""
    return (np.linalg.inv(scatter) * np.where(np.eye(_P, dtype=bool), 1, 2))[_UPPER_AT].tolist()


def _distance() -> Column:
    """Squared distance of the features from ``centre`` by ``inverse``."""
    gap = [F.col(f"f{i}") - F.col("centre")[i] for i in range(_P)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        out = out + gap[i] * gap[j] * F.col("inverse")[k]
    return out


_ESTIMATE = "key string, start int, rows long, centre array<double>, scatter array<double>, inverse array<double>, logdet double"


def _estimate(key, start, rows, centre, scatter) -> tuple:
    return key, start, rows, list(centre), scatter[_UPPER_AT].tolist(), _for_distance(scatter), float(np.linalg.slogdet(scatter)[1])


def _starts(frames):
    """Quartiles, squashed correlations and sign covariances of each key to three starts."""
    resolution = np.diag(np.square(FLOORS))
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            spread, mean = np.array(r.spread, float), np.array(r.tm, float)
            scale = np.outer(spread, spread)
            squashed, signs = _full(r.ts) - np.outer(mean, mean), _full(r.us) * _P
            for k, scatter in enumerate((np.diag(spread**2), scale * squashed + resolution, scale * signs + resolution)):
                out.append(_estimate(r.key, k, r.rows, r.centre, scatter))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])


def _concentrated(core: float):
    """Means and second moments of each key's and start's nearest rows to an estimate."""
    factor, resolution = consistency(core), np.diag(np.square(FLOORS))

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean = np.array(r.m, float)
                out.append(_estimate(r.key, r.start, r.rows, mean, factor * (_full(r.s) - np.outer(mean, mean)) + resolution))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])

    return run


def _with(rows: DataFrame, table: DataFrame, small: bool, on: tuple[str, ...] = ("key",), how: str = "inner") -> DataFrame:
    """Rows and what the table says of their key; a table too large to broadcast is repeated for each part of a key's rows."""
    if small:
        return rows.join(F.broadcast(table), list(on), how)
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "__salt"], how).drop("__salt")


def _moments(columns: list[Column]) -> Column:
    return F.array(*(F.avg(columns[i] * columns[j]) for i, j in _PAIRS))


def _step(cloud: DataFrame, now: DataFrame, core: float, small: bool) -> DataFrame:
    """One concentration step for every key and start of ``now``."""
    far = _with(cloud, now.select("key", "start", "centre", "inverse"), small).withColumn("d", _distance()).drop("centre", "inverse")
    edge = far.groupBy("key", "start").agg(F.percentile_approx("d", F.lit(core), F.lit(2000)).alias("edge"))
    near = _with(far, edge, small, ("key", "start")).filter("d <= edge")
    features = [F.col(f"f{i}") for i in range(_P)]
    moments = near.groupBy("key", "start").agg(F.array(*map(F.avg, features)).alias("m"), _moments(features).alias("s"))
    return staged(moments.join(now.select("key", "start", "rows"), ["key", "start"]).select("key", "start", "rows", "m", "s").mapInPandas(_concentrated(core), _ESTIMATE), "estimate")


def estimates(cloud: DataFrame, core: float = CORE, first_steps: int = FIRST_STEPS, more_steps: int = MORE_STEPS) -> DataFrame:
    """key, rows, centre, scatter and logdet of every key of ``cloud`` (key, f0 ..): minimum-covariance-determinant estimates."""
    quartiles = cloud.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *(F.percentile_approx(f"f{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(f"q{i}") for i in range(_P)))
    spread = F.array(*(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floor)) for i, floor in enumerate(FLOORS)))
    middle = staged(quartiles.select("key", "rows", F.array(*(F.col(f"q{i}")[1] for i in range(_P))).alias("centre"), spread.alias("spread")), "middle")
    small = middle.count() <= BROADCAST_KEYS
    z = [(F.col(f"f{i}") - F.col("centre")[i]) / F.col("spread")[i] for i in range(_P)]
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0"))), F.lit(1e-12))
    standard = _with(cloud, middle.drop("rows"), small).select("key", *(x.alias(f"z{i}") for i, x in enumerate(z))).withColumn("norm", norm)
    squashed, signs = ([f(F.col(f"z{i}")) for i in range(_P)] for f in (F.tanh, lambda x: x / F.col("norm")))
    begun = standard.groupBy("key").agg(F.array(*map(F.avg, squashed)).alias("tm"), _moments(squashed).alias("ts"), _moments(signs).alias("us"))
    now = staged(begun.join(middle, "key").mapInPandas(_starts, _ESTIMATE), "starts")
    for _ in range(first_steps):
        now = _step(cloud, now, core, small)
    best = now.groupBy("key").agg(F.min(F.struct("logdet", "start")).alias("best")).select("key", F.col("best.start").alias("start"))
    now = staged(now.join(best, ["key", "start"]), "best")
    for _ in range(more_steps):
        new = _step(cloud, now, core, small)
        moved = new.join(now.select("key", F.col("logdet").alias("was")), "key").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        now = new
        if moved is None or moved < SETTLED:
            break
    return now.select("key", "rows", "centre", "scatter", "logdet")


def drawn(n: int, centre, scatter, parent: tuple | None, prior: int = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of ``n`` rows of its own and ``prior`` rows of its parent's: what the two clouds have together."""
    if parent is None:
        return np.array(centre, float), _full(scatter)
    if not n:
        return parent
    w = n / (n + prior)
    mean = w * np.array(centre, float) + (1 - w) * parent[0]
    own, other = np.array(centre, float) - mean, parent[0] - mean
    return mean, w * (_full(scatter) + np.outer(own, own)) + (1 - w) * (parent[1] + np.outer(other, other))


def _drawn_down(frames):
    """Estimates of a source, its language and all rows to what the source's documents are measured by."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            now = None
            for e in (r.e2, r.e1, r.e0):
                if e is not None:
                    now = drawn(e["rows"], e["centre"], e["scatter"], now)
            if now is not None:
                out.append((r.key, now[0].tolist(), _for_distance(now[1])))
        yield pd.DataFrame(out, columns=["key", "centre", "inverse"])


def verdicts(docs: DataFrame, kept_part: float = KEPT_PART) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every row.

    Estimates rest on the documents that pass the base limits; a group of any
    size has one, drawn towards its language's. A document stays if it passes
    the base limits and its squared ``distance`` is at most the chi-square
    quantile at ``kept_part``; ties of distances at a subset's edge are all in
    it. A null language or source is the name ''. Repeated rows are judged each
    on its own, whatever their ids; a null or empty text has no words and fails;
    texts of any length are counted whole; an empty table gives an empty result.
    Where no document passes the base limits, distances are null. Other columns
    of ``docs``, whatever their names, are left alone.
    """
    rows = staged(statistics(docs).withColumns({f"f{i}": f for i, f in enumerate(_features())}).withColumn("base_failed", base_failed()), "statistics")
    names = [F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("all")]
    features = [f"f{i}" for i in range(_P)]
    cloud = rows.filter("NOT base_failed").select(F.explode(F.array(*names)).alias("key"), *features)
    table = estimates(cloud)
    tree = rows.select(*(x.alias(f"key{k}") for k, x in enumerate(names))).distinct()
    for k in range(3):
        tree = tree.join(table.select(F.col("key").alias(f"key{k}"), F.struct("rows", "centre", "scatter").alias(f"e{k}")), f"key{k}", "left")
    measured = staged(tree.select(F.col("key0").alias("key"), "e0", "e1", "e2").mapInPandas(_drawn_down, "key string, centre array<double>, inverse array<double>"), "measures")
    out = _with(rows.withColumn("key", names[0]), measured, measured.count() <= BROADCAST_KEYS, how="left").withColumn("distance", _distance())
    cut = chi_square_quantile(kept_part, _P)
    return out.select("doc_id", *_STATS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"), "distance")
