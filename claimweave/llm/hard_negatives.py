"""Hard-negative mining: every anchor's integer scores are sorted in full, each positive's limits found in them by binary search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Components are this many times their value, rounded down, and held within this bound.
SCALE, LARGEST = 256, 1 << 26
#: Anchors of a pass over all rows; with their components they bound what is broadcast.
ANCHOR_BYTES = 1 << 25
#: Rows that are scored at once, and anchors scored against them: bound the memory of a task.
ROWS, ANCHORS = 1 << 14, 1 << 8


@dataclass(frozen=True)
class Mining:
    """What is mined: how many positives of an anchor, negatives of a positive, and negatives' percent of the positive's score."""

    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    most_percent: int = 100


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), odd)


def taking_part(embeddings: DataFrame, anchor: Column, label: Column | None = None) -> DataFrame:
    """row, vec_id, label, anchor, vector of the rows that take part, quantised to whole numbers."""
    label = F.col("label") if label is None else label
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * SCALE))).cast("int"))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("embedding")))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("vector"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, int)])] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products. By Cauchy and Schwarz no sum on the way is larger than the product of the longest vectors' lengths, so floats are exact below their mantissa."""
    far = np.sqrt((anchors.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((rows.astype(float) ** 2).sum(1).max(initial=0))
    kind = np.float32 if far < 1 << 23 else np.float64 if far < 1 << 52 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def ranked(score: np.ndarray) -> np.ndarray:
    """Places of the scores, highest first, equal ones in order of place (rows come in order of id)."""
    bits = max(1, len(score) - 1).bit_length()
    if len(score) and max(int(score.max()), -int(score.min())) < 1 << (62 - bits):
        return np.sort((-score << bits) | np.arange(len(score))) & ((1 << bits) - 1)
    return np.argsort(-score, kind="stable")


@dataclass
class Anchors:
    """A block of anchors as a task gets it."""

    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    limits: list[list[tuple[int, int]]] | None = None  # of each anchor: (positive's row, its score)


class _Best:
    """For each key the best few (score, id, row), kept while rows stream by."""

    def __init__(self, many: int) -> None:
        self.many, self.held = many, {}

    def add(self, key, found: list[tuple[int, int, int]]) -> None:
        if found:
            self.held[key] = sorted(self.held.get(key, []) + found, key=lambda x: (-x[0], x[1], x[2]))[: self.many]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, id, label and vectors of some rows, in order of id."""
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            row, vec_id, label = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            order = np.lexsort((row, vec_id))
            yield row[order], vec_id[order], label[order], _matrix(part.column("vector"), width)[order]


def _best_per(found: DataFrame, key: list[str], many: int) -> DataFrame:
    """Of what tasks have found (each at most ``many`` for a key) the best ``many``, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= many)


def _positives(rows: DataFrame, anchors, width: int, many: int) -> DataFrame:
    """anchor, other, vec_id, score: of every task the best rows of each anchor's label but itself."""

    def run(batches):
        own, best = anchors.value, _Best(many)
        of_label = {int(x): np.flatnonzero(own.label == x) for x in np.unique(own.label)}
        for row, vec_id, label, vector in _blocks(batches, width):
            for x in np.unique(label):
                at = np.flatnonzero(label == x)
                for lo in range(0, len(mine := of_label.get(int(x), ())), ANCHORS):
                    some = mine[lo : lo + ANCHORS]
                    table = scores(own.vector[some], vector[at])
                    for k, score in zip(some.tolist(), table, strict=True):
                        top = [i for i in ranked(score)[: many + 1].tolist() if row[at[i]] != own.row[k]][:many]
                        best.add(k, [(int(score[i]), int(vec_id[at[i]]), int(row[at[i]])) for i in top])
        yield _told([(int(own.row[k]), r, i, s) for k, found in best.held.items() for s, i, r in found], ("anchor", "other", "vec_id", "score"))

    return rows.mapInArrow(run, "anchor long, other long, vec_id long, score long")


def _told(out: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], list(names))


def _negatives(rows: DataFrame, anchors, width: int, mining: Mining) -> DataFrame:
    """anchor, positive, positive_score, other, vec_id, score: of every task the best rows of other labels within each positive's limits."""
    least, most = mining.least_percent, mining.most_percent

    def run(batches):
        own, best = anchors.value, _Best(mining.negatives)
        for row, vec_id, label, vector in _blocks(batches, width):
            for lo in range(0, len(own.row), ANCHORS):
                for k, score in enumerate(scores(own.vector[lo : lo + ANCHORS], vector), lo):
                    order = ranked(score)
                    falling, other = -score[order], label[order] != own.label[k]
                    for positive, limit in own.limits[k]:
                        # least * limit <= 100 * score <= most * limit
                        a = int(np.searchsorted(falling, -(most * limit // 100), "left"))
                        b = int(np.searchsorted(falling, least * -limit // 100, "right"))
                        at, found = a, []
                        while at < b and len(found) < mining.negatives:
                            step = order[at : min(b, at + 64)]
                            found += step[other[at : at + len(step)]][: mining.negatives - len(found)].tolist()
                            at += 64
                        best.add((k, positive, limit), [(int(score[i]), int(vec_id[i]), int(row[i])) for i in found])
        yield _told([(int(own.row[k]), p, limit, r, i, s) for (k, p, limit), found in best.held.items() for s, i, r in found], ("anchor", "positive", "positive_score", "other", "vec_id", "score"))

    return rows.mapInArrow(run, "anchor long, positive long, positive_score long, other long, vec_id long, score long")


def mined(embeddings: DataFrame, anchor: Column, label: Column | None = None, mining: Mining = Mining(), anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row where ``anchor`` holds.

    The table is quantised once; then every block of anchors (``anchor_bytes``
    at most, broadcast) meets all rows where they lie, twice: first for the
    nearest rows of its label, then, in every task's full order of scores, for
    the different-label rows within each positive's limits. Only the few best
    of each task and anchor are shuffled, whatever labels are frequent.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part. Ties go by the smaller id, then by row; of rows with equal
    ids each is a row of its own, and "other rows" are all but the anchor's own
    row. Vectors of different lengths are compared as if the shorter ended in
    zeros. Components of over 2^26 (values of over 262,144) count as 2^26, so
    that scores of up to 1,024 components fit a long. A negative score of the
    positive leaves no room between its limits. Without anchors, or without
    rows, the result is empty; other columns are left out.
    """
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = staged(taking_part(embeddings, anchor, label), "quantised")
    asking = rows.filter("anchor")
    n, width = asking.agg(F.count(F.lit(1)), F.lit(0)).first()[0], rows.agg(F.max(F.size("vector"))).first()[0] or 0
    each = max(1, anchor_bytes // (4 * width + 32))
    blocks = -(-n // each)
    # a block's number comes from the row's digest; a block may be a little larger than its share
    asking = staged(asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))).select("block", "row", "vec_id", "label", "vector"), "anchors")
    out = None
    for block in range(blocks):
        table = asking.filter(F.col("block") == block).toArrow()  # a block
        held = Anchors(table.column("row").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vector"), width))
        sent = spark.sparkContext.broadcast(held)
        near = staged(_best_per(_positives(rows, sent, width, mining.positives), ["anchor"], mining.positives).select("anchor", F.col("other").alias("positive"), F.col("vec_id").alias("positive_id"), "score"), "positives")
        number = {int(r): k for k, r in enumerate(held.row)}
        held.limits = [[] for _ in held.row]
        for r in near.select("anchor", "positive", "score").collect():  # a few for each anchor of the block
            held.limits[number[r.anchor]].append((r.positive, r.score))
        sent = spark.sparkContext.broadcast(held)
        found = _best_per(_negatives(rows, sent, width, mining), ["anchor", "positive"], mining.negatives)
        named = found.join(near.select("anchor", "positive", "positive_id"), ["anchor", "positive"]).join(asking.filter(F.col("block") == block).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        done = staged(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], schema) if out is None else out


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: every vec_id divisible by 100 is an anchor; where it is divisible by 7, the label is moved on by one (of ten) first."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return mined(embeddings, vec_id % 100 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


#: DuckDB SQL for ``hard_negatives`` over ``embeddings`` with unique vec_id and vectors of one length.
HARD_NEGATIVES_SQL = """
WITH part AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM part a JOIN part b ON a.id % 100 = 0 AND a.id <> b.id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
