"""Joins by outcome, by nearness, by range and by similarity."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import edited_forms, sequence_ratio
from ..sources.staging import staged

#: Hashes of a block, and pairs compared at a time.
BLOCK, CELLS = 8192, 1 << 20
#: Names of a block that meet all its reference names in one group.
NAMES = 256


def unique_match(requests: DataFrame, reference: DataFrame, key: str, attributes: list[str], request_id: str) -> DataFrame:
    """request_id, outcome and matches of every request.

    NO_MATCH without a reference row of the key, CONFLICT_NOT_UNIQUE with
    several, else MATCH if the attributes both sides have are equal, CONFLICT
    if not. ``reference`` is counted per key before the join, so a key that
    occurs often isn't multiplied out.
    """
    one = reference.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), *(F.min(a).alias(f"ref_{a}") for a in attributes))
    joined = requests.join(one, key, "left")
    same = F.lit(True)
    for a in attributes:
        same = same & F.coalesce(F.col(a) == F.col(f"ref_{a}"), F.lit(True))
    outcome = F.when(F.col("matches").isNull(), "NO_MATCH").when(F.col("matches") > 1, "CONFLICT_NOT_UNIQUE").when(same, "MATCH").otherwise("CONFLICT")
    return joined.select(request_id, outcome.alias("outcome"), F.coalesce("matches", F.lit(0)).alias("matches"))


def last_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` must leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return df.withColumn("__last", F.row_number().over(w)).filter("__last = 1").drop("__last")


def nearest(points: DataFrame, targets: DataFrame, x: str, at: str, name: str) -> DataFrame:
    """Each point with the target nearest to it; of equally near ones the first by name.

    ``targets`` is a layout, sent whole: a few rows as one sorted array.
    """
    all_targets = targets.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(at).cast("double").alias("at")))).alias("targets"))
    gaps = F.transform("targets", lambda t: F.struct(F.abs(F.col(x) - t["at"]).alias("gap"), t["name"].alias("name")))
    return points.crossJoin(F.broadcast(all_targets)).withColumn("nearest", F.array_min(gaps)).select(*points.columns, F.col("nearest.name").alias(name), F.col("nearest.gap").alias("gap"))


def in_cells(points: DataFrame, cells: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points joined to the boxes (x0, y0, x1, y1, half open) that hold them, by equal tiles.

    Each box is listed under the tiles of ``size`` it touches and a point under
    its own, so the join is on equal keys however many boxes there are.
    """
    tiled = cells.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    at = points.withColumn("tx", F.floor(F.col(x) / size)).withColumn("ty", F.floor(F.col(y) / size))
    inside = (F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y1"))
    return at.join(tiled, ["tx", "ty"]).filter(inside).drop("tx", "ty")


def hamming_pairs(hashes: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Pairs (a, b, distance) of 64-bit hashes that differ in at most ``most`` bits.

    Cut into ``most + 1`` bands, each of a bit or more, two such hashes share a
    whole band, so only rows with an equal band are compared. Equal hashes are
    compared once, as one, and named by their smallest key; ``copies`` tells
    how many there are. A band of b bits sorts rows into 2^b buckets, so the
    pairs compared grow with the square of the rows as soon as these outnumber
    the buckets: ``most`` above 7 (bands of fewer than 8 bits) is for tables of
    some hundred thousand hashes only.
    """
    cuts = [k * 64 // (most + 1) for k in range(most + 2)] if most < 64 else [0, 0]  # beyond 63 bits every pair is one
    one = hashes.groupBy(value).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    if most > 7:
        return _tiled_pairs(one, key, value, most)
    parts = [F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long")) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    bands = F.array(*(F.struct(F.lit(k).alias("band"), bits.alias("bits")) for k, bits in enumerate(parts)))
    rows = one.select(F.col(key).alias("k"), F.col(value).alias("v"), F.explode(bands).alias("b")).select("k", "v", "b.band", "b.bits")
    left, right = rows.select(F.col("k").alias("a"), F.col("v").alias("va"), "band", "bits"), rows.select(F.col("k").alias("b"), F.col("v").alias("vb"), "band", "bits")
    distance = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    return left.join(right, ["band", "bits"]).filter("a < b").select("a", "b", distance.alias("distance")).filter(F.col("distance") <= most).distinct()


def _tiled_pairs(one: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """``hamming_pairs`` of different hashes by all pairs: each of B blocks meets itself and the others, in a group for each two."""
    one = staged(one.select(key, value).dropna(), "hashes")
    blocks = max(1, -(-one.count() // BLOCK))
    kind = one.schema[key].dataType.simpleString()
    block = F.pmod(F.xxhash64(value), F.lit(blocks)).cast("int")
    with_other = one.select(F.col(key).alias("k"), F.col(value).alias("v"), block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = with_other.select("k", "v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("first"))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        same = frame["p"].iat[0] == frame["q"].iat[0]
        left = frame if same else frame[frame["first"]]
        right = frame if same else frame[~frame["first"]]
        v, w = left["v"].to_numpy(np.int64).view(np.uint64), right["v"].to_numpy(np.int64).view(np.uint64)
        step, at, to, gaps = max(1, CELLS // max(1, len(w))), [], [], []
        for lo in range(0, len(v), step):
            gap = np.bitwise_count(v[lo : lo + step, None] ^ w)
            i, j = np.nonzero(gap <= most)
            if same:
                i, j = i[i + lo < j], j[i + lo < j]
            at, to, gaps = [*at, i + lo], [*to, j], [*gaps, gap[i, j]]
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        a, b = left["k"].take(join(at)).reset_index(drop=True), right["k"].take(join(to)).reset_index(drop=True)
        return pd.DataFrame({"a": a.where(a < b, b), "b": b.where(a < b, a), "distance": join(gaps).astype(np.int32)})

    return rows.groupBy("p", "q").applyInPandas(near, f"a {kind}, b {kind}, distance int")


@dataclass(frozen=True)
class Likeness:
    """A similarity of two names (higher is more alike), the edits that names are first looked up by, and what is the most that names further apart can reach.

    ``most(size, longest, edits)``: of a name of ``size`` letters and any up to
    ``longest``, if there are ``edits`` or more between them. It must be a
    quotient of whole numbers as the similarity is, or less 1 of one, so that equal values compare as equal.
    """

    similarity: Callable[[Column, Column], Column]
    most: Callable[[Column, Column, int], Column]
    steps: tuple[int, ...]
    exchange: bool


#: Edit distance in parts of the longer name.
BY_EDITS = Likeness(lambda a, b: 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b)), lambda size, longest, edits: 1 - edits / F.greatest(size, longest).cast("double"), (1, 2, 3), True)
#: Ratio of matching blocks: these are a common subsequence, so all letters outside one count as cut out.
BY_BLOCKS = Likeness(sequence_ratio, lambda size, longest, edits: (size + longest - edits).cast("double") / (size + longest), (2, 4), False)


def most_similar(asked: DataFrame, reference: DataFrame, block: list[str], name: str, key: str, like: Likeness) -> DataFrame:
    """``asked`` with ``key`` and similarity of the reference row of its block whose name is most like its own; of equally like ones the smallest ``key``.

    Exact, without meeting all names of a block: each different name is looked
    up once, first by its forms after a few edits (an equi-join), then after
    more. A name is settled as soon as what it found is more like it than
    anything further apart can be. Only the names that no step settles meet
    their whole block; the fuller a block, the fewer these are. What all names
    begin with has no part in the edits. Rows of blocks without reference are
    left out, and null names are like none.

    Names are few bytes as files and many as forms, so joins don't go by the
    size of files: only the list of full blocks, a row for ``NAMES`` names or
    more, is sent whole.
    """
    ref = staged(reference.groupBy(*block, F.col(name).alias("__ref")).agg(F.min(key).alias(key)), "reference")
    left = staged(asked.select(*block, name).distinct(), "asked")
    all_names = ref.select(F.col("__ref").alias("n")).unionByName(left.select(F.col(name).alias("n")))
    ends = all_names.agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min(F.length("n")).alias("least"), F.max(F.length("n")).alias("longest")).first()
    same = len(os.path.commonprefix([ends["first"] or "", ends["last"] or ""]))
    best = F.min_by(F.struct("similarity", key), F.struct(F.isnull("similarity"), -F.col("similarity"), key)).alias("__best")
    settled, tasks = None, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows with much work each
    for edits in like.steps if ends["first"] is not None else ():
        def by_form(rows: DataFrame, text: str, cut: str, edits: int = edits) -> DataFrame:
            form = edited_forms(F.substring(F.col(text), F.lit(same + 1), F.length(text)), ends["least"] - same, edits, like.exchange)
            return rows.repartition(tasks, *block, text).withColumn("__form", F.explode(form)).withColumns({cut: F.ascii("__form") - 48, "__form": F.substring("__form", 2, 1 << 30)})

        met = by_form(left, name, "__a").join(by_form(ref, "__ref", "__b").hint("merge"), [*block, "__form"]).filter(F.col("__a") + F.col("__b") + F.ascii("__form") - 48 <= edits)
        found = met.select(*block, name, "__ref", key).distinct().withColumn("similarity", like.similarity(F.col(name), F.col("__ref"))).groupBy(*block, name).agg(best)
        sure = F.coalesce(F.col("__best.similarity") > like.most(F.length(name), F.lit(ends["longest"]), edits + 1), F.lit(False))
        tried = staged(left.join(found, [*block, name], "left").withColumn("__sure", sure), "tried")
        done, left = tried.filter("__sure").drop("__sure"), tried.filter("NOT __sure").select(*block, name)
        settled = done if settled is None else settled.unionByName(done)
    full = left.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / NAMES).cast("int").alias("__parts")).filter("__parts > 1")
    of_parts = lambda rows: rows.join(F.broadcast(full), block, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    parts = of_parts(left).select(*block, name, F.pmod(F.xxhash64(name), "__parts").cast("int").alias("__part"))
    each = of_parts(ref).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    rest = parts.join(each.hint("merge"), [*block, "__part"]).withColumn("similarity", like.similarity(F.col(name), F.col("__ref"))).groupBy(*block, name).agg(best)
    settled = rest if settled is None else settled.unionByName(rest)
    names = settled.select(*(F.col(b).alias(f"__{b}") for b in block), F.col(name).alias("__name"), "__best")
    equal = F.col(name).eqNullSafe(F.col("__name"))
    for b in block:
        equal = equal & (F.col(b) == F.col(f"__{b}"))
    return asked.join(names.hint("merge"), equal).select(*asked.columns, F.col(f"__best.{key}").alias(key), F.col("__best.similarity").alias("similarity"))


def exact_binding(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """left_id, outcome and targets: rows bound by any of several keys; one target is exact, more are ambiguous.

    ``right`` has a row for each ``right_id``. It is counted per key, and per
    combination of keys, before it is joined, so a key that occurs often isn't
    multiplied out: what any of the keys binds is what each binds, less what
    two do, and so on. Meant for a few keys.
    """
    out, targets = left, F.lit(0)
    for n in range(1, len(keys) + 1):
        for k, some in enumerate(combinations(keys, n)):
            name = f"__n{n}_{k}"
            counted = right.dropna(subset=list(some)).groupBy(*some).agg(F.count(F.lit(1)).alias(name))
            out = out.join(counted, list(some), "left")
            targets = targets + (1 if n % 2 else -1) * F.coalesce(name, F.lit(0))
    out = out.select(left_id, targets.cast("long").alias("targets"))
    outcome = F.when(F.col("targets") == 0, "NOT_FOUND").when(F.col("targets") == 1, "MATCHED_EXACT").otherwise("AMBIGUOUS")
    return out.select(left_id, outcome.alias("outcome"), "targets")
