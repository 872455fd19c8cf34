"""Exact n-gram Jaccard self-join and its groups.

The join follows the prefix principle with token combinations. All shingles
are counted over the corpus and fall into two classes, rare and frequent; sets
are ordered rare shingles first. A rare shingle of a prefix is indexed alone.
Frequent shingles are spread over sub-classes and indexed in pairs within one,
for which the prefix is extended until it holds

    rare + sum(max(0, count of a sub-class - 1))  >=  size - overlap + 1

entries: two linked sets then share a rare shingle or a pair. How many sub-
classes there are depends on the size band; a set is indexed under its own and
the next band, and linked sets share one of these. Candidates pass a length
and a position filter and are verified on their whole sets.

Equal sets are one from the start. Each set has a parity bitmap of two to four
bits a shingle; bits that differ bound the shingles that differ from below, so
most candidates are refused without fetching their sets. A long posting list is
never expanded into all its pairs: a task sends on one member of what it has of
it, it is linked to one centre, and what is then outside its largest group is
compared by bitmaps, in blocks, with all members. Partners that may link are
verified, the nearest ones first where there are many; such lists are looked at
again as long as their groups merge. That settles the groups. Where each set's
number of links is asked for, the sets of a group are then intersected exactly,
in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..sources.staging import staged
from . import words

#: Words of a shingle.
SHINGLE = 4
#: Sets link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Entries of the table of frequent shingles, which is broadcast: 4 bytes each.
FREQUENT_TABLE = 1 << 18
#: Documents a shingle must be in to be frequent (more, where the table would overflow).
FREQUENT_FROM = 32
#: A posting list up to this length gives all its pairs at once; longer ones are linked round by round.
SHORT_LIST = 24
#: Partners of a member that are verified at once; with more of them its lists are looked at again.
NEAREST = 16
#: Rounds of that, before all that is left is verified.
NEAREST_ROUNDS = 8
#: Members of a list that are compared in one task, with as many others.
BLOCK_MEMBERS = 1024
#: Bytes of the sets of a group whose links are counted in one task, with as many others; and rows of the counts held at once.
TILE_BYTES, STRIP, COLUMNS = 1 << 25, 512, 512
#: Members of groups up to which they are broadcast to their sets, so that those are only shuffled to their tiles (60 bytes each).
BROADCAST_MEMBERS = 200_000
#: Rows up to which a table of lists or of set ids is broadcast (16 bytes each).
BROADCAST_LISTS = 200_000
#: Bits for each set of the Bloom filter that finds those to verify, and a filter's at least and at most (64 MB).
BLOOM_EACH, LEAST_BLOOM_BITS, MOST_BLOOM_BITS = 32, 1 << 20, 1 << 29

_FLUSH = 1 << 18  # entries a task holds before it sends them on
_BAND = 1.18  # more than 1 / 0.85, so linked sets are in the same or in neighbouring bands


def set_id(shingles: np.ndarray) -> int:
    """A 63-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1


def overlap_of(size: int, threshold: int = THRESHOLD) -> int:
    """The least overlap of a set of this size with any set it links to."""
    return -(-threshold * size // 100)


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Of each place, whether an odd number of shingles falls on it; as many places as twice the shingles, to the next power of two."""
    places = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """Rows of a parity bitmap brought down to ``size`` words, a power of two."""
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def _may_link(na, nb, differ, threshold: int):
    """Can sets of these sizes link, if so many places of their bitmaps differ?"""
    need = -(-threshold * (na + nb) // (100 + threshold))
    return differ <= na + nb - 2 * need


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id and bitmap (null for an empty set) of every document; and its row key, if ``docs`` has one."""
    key = [c for c in docs.columns if c in ("__null", "__id", "__digest")]
    kinds = "".join(f", {c} {t}" for c, t in docs.select(*key).dtypes)

    def run(batches):
        for batch in batches:
            for lo, hi, raw, offs in words.chunks(batch.column(1)):
                sets = words.shingle_sets(raw, offs, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([set_id(x) if len(x) else None for x in sets], pa.int64()),
                        pa.array([parity_bitmap(x) if len(x) else None for x in sets], pa.binary()),
                        *(c.slice(lo, hi - lo) for c in batch.columns[2:]),
                    ],
                    ["doc_id", "n_shingles", "set_id", "bitmap", *key],
                )

    return _source(docs, key).mapInArrow(run, f"doc_id long, n_shingles long, set_id long, bitmap binary{kinds}")


def _source(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(more or []))


def _buckets(entries: float, each: int) -> int:
    return 1 << max(4, min(20, math.ceil(math.log2(max(1.0, entries / each)))))


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and length of each run of equal entries."""
    starts = np.flatnonzero(np.append(len(sorted_) > 0, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def frequent_codes(docs: DataFrame, total: int, shingle: int = SHINGLE, least: int = FREQUENT_FROM, table: int = FREQUENT_TABLE) -> np.ndarray:
    """Sorted 32-bit codes of the frequent shingles, counted over all documents.

    A code's count is that of all shingles that share it, which can only make
    more of them frequent. At most ``table`` codes reach ``total / table``.
    """
    floor = max(least, total // table + 1)
    bits = int(math.log2(_buckets(total, 500_000)))

    def send(codes: list[np.ndarray], counts: list[np.ndarray]):
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(counts)).astype(np.uint32)
        bucket = code >> np.uint32(32 - bits)
        starts, sizes = _runs(bucket)
        rows = [(int(bucket[x]), zlib.compress(np.diff(code[x : x + m], prepend=np.uint32(0)).tobytes(), 1), zlib.compress(count[x : x + m].tobytes(), 1)) for x, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "codes", "counts"])

    def count(batches):
        held, counts, n = [], [], 0
        for batch in batches:
            for _, _, raw, offs in words.chunks(batch.column(1)):
                sets = words.shingle_sets(raw, offs, shingle)
                code, k = np.unique((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), return_counts=True)
                held.append(code)
                counts.append(k)
                n += len(code)
                if n > 2 * _FLUSH:
                    yield send(held, counts)
                    held, counts, n = [], [], 0
        if n:
            yield send(held, counts)

    def add(key, batch):
        code = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), np.uint32), dtype=np.uint32) for x in batch.column("codes").to_pylist()])
        k = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in batch.column("counts").to_pylist()])
        code, inverse = np.unique(code, return_inverse=True)
        hot = code[np.bincount(inverse, k) >= floor]
        return pa.table({"code": pa.array(hot.astype(np.int64), pa.int64())})

    found = _source(docs).mapInArrow(count, "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(add, "code long")
    return np.sort(np.array([r.code for r in found.collect()], np.uint32))


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(_BAND))


def sub_classes(band: int) -> int:
    return max(1, int(0.1 * _BAND**band))


def signatures(shingles: np.ndarray, frequent: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is indexed, and each one's place in the set's order (-1 for a pair's key)."""
    n = len(shingles)
    need = n - overlap_of(n, threshold) + 1
    rare, hot = shingles[~frequent], shingles[frequent]
    if len(rare) >= need:
        return rare[:need], np.arange(need)
    keys = [rare]
    for band in (band_of(n), band_of(n) + 1):
        m = sub_classes(band)
        group = (words.mix(hot ^ np.uint64(band)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at = np.empty(len(hot), np.int64)  # how many of its sub-class come before it
        at[order] = np.arange(len(hot)) - np.searchsorted(group[order], group[order])
        reach = np.cumsum(at > 0) + len(rare) >= need
        end = int(np.argmax(reach)) + 1 if reach.any() else len(hot)
        group, part, at = group[:end], hot[:end], at[:end]
        order = np.argsort(group, kind="stable")
        part, at = part[order], at[order]
        second = np.repeat(np.arange(end), at)
        first = second - 1 - (np.arange(len(second)) - np.repeat(np.cumsum(at) - at, at))
        keys.append(words.mix(words.mix(part[first] + np.uint64(band)) ^ (part[second] * np.uint64(0xD6E8FEB86659FD93))))
    out = np.concatenate(keys)
    return out, np.concatenate([np.arange(len(rare)), np.full(len(out) - len(rare), -1)])


_POSTING = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<i4"), ("at", "<i4")])
_LONG = 1 << 30  # taken off ``at`` of a posting that stands for a task's long list
_FOUND = "kind int, key long, a long, b long"


def _linkable(na, nb, ia, ib, threshold: int):
    """Length and position filter: can two sets that share an entry at these places link?"""
    need = -(-threshold * (na + nb) // (100 + threshold))
    free = (ia < 0) | (ib < 0)
    most = np.where(free, np.minimum(na, nb), np.minimum(ia, ib) + 1 + np.minimum(na - ia - 1, nb - ib - 1))
    return (most >= need) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))


def candidates(docs: DataFrame, frequent: np.ndarray, total: int, shingle: int, threshold: int, short: int = SHORT_LIST) -> DataFrame:
    """Rows of kind 0: pairs of sets to verify; of kind 1: members of long posting lists (key, a)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequent)
    bits = int(math.log2(_buckets(0.2 * total, 200_000)))

    def send(held):
        keys, sets, ns, at = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = np.empty(len(keys), _POSTING)
        rows["key"], rows["set"], rows["n"], rows["at"] = keys, sets, ns, at
        rows = rows[np.lexsort((rows["set"], rows["key"]))]
        starts, sizes = _runs(rows["key"])
        # what this task has of a long list goes anywhere; one of it stands for it where the key's postings meet
        many = np.repeat(sizes > short, sizes)
        lists = rows[many]
        rows["at"][starts[sizes > short]] -= _LONG
        many[starts] = False
        rows = rows[~many]
        bucket = (rows["key"] >> np.uint64(64 - bits)).astype(np.int64)
        starts, sizes = _runs(bucket)
        out = [(b, rows[x : x + m].tobytes()) for b, x, m in zip(bucket[starts].tolist(), starts.tolist(), sizes.tolist(), strict=True)]
        starts, sizes = _runs(lists["key"])
        out += [((1 << bits) + int(lists["set"][x] % (1 << bits)), lists[x : x + m].tobytes()) for x, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "postings"])

    def index(batches):
        hot = sent.value
        coarse = np.zeros(1 << 20, bool)
        coarse[(hot >> np.uint32(12)).astype(np.int64)] = True
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, _, raw, offs in words.chunks(batch.column(1)):
                for s in words.shingle_sets(raw, offs, shingle):
                    if len(s) < 2 or (name := set_id(s)) in seen:  # a single shingle links to its equals only
                        continue
                    seen.add(name)
                    often = coarse[(s >> np.uint64(44)).astype(np.int64)]
                    if often.any():
                        codes = (s[often] >> np.uint64(32)).astype(np.uint32)
                        spot = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
                        often[often] = hot[spot] == codes
                    keys, at = signatures(s, often, threshold)
                    held.append((keys, np.full(len(keys), name), np.full(len(keys), len(s), np.int32), at))
                    size += len(keys)
                    if size > _FLUSH:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    def pairs(key, batch):
        rows = np.concatenate([np.frombuffer(x, _POSTING) for x in batch.column("postings").to_pylist()])
        rows = rows[np.lexsort((rows["at"], rows["set"], rows["key"]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
        rows = rows[fresh]
        stands = rows["at"] < -(_LONG >> 1)
        rows["at"][stands] += _LONG
        starts, sizes = _runs(rows["key"])
        # a task's part of a long list is one whatever is left of it, as the rest of the list is elsewhere
        is_long = (sizes > short) | np.logical_or.reduceat(stands, starts) | (key[0].as_py() >= 1 << bits)
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(sizes[(sizes > 1) & ~is_long]).tolist():
            i, j = np.triu_indices(m, 1)
            at = starts[(sizes == m) & ~is_long][:, None]
            firsts.append((at + i).ravel())
            seconds.append((at + j).ravel())
        long_ = [np.arange(s, s + m) for s, m in zip(starts[is_long].tolist(), sizes[is_long].tolist(), strict=True)]
        for x in long_:
            firsts.append(np.full(len(x) - 1, x[0]))
            seconds.append(x[1:])
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        ok = _linkable(*(rows[k][x].astype(np.int64) for k, x in (("n", i), ("n", j), ("at", i), ("at", j))), threshold)
        i, j = i[ok], j[ok]
        pair = np.unique(np.stack([rows["set"][i], rows["set"][j]], 1), axis=0)
        x = np.concatenate(long_) if long_ else np.zeros(0, np.int64)
        zero = np.zeros(len(x), np.int64)
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [len(pair), len(x)]), pa.int32()),
                "key": pa.array(np.concatenate([np.zeros(len(pair), np.int64), rows["key"][x].view(np.int64)]), pa.int64()),
                "a": pa.array(np.concatenate([pair[:, 0], rows["set"][x]]), pa.int64()),
                "b": pa.array(np.concatenate([pair[:, 1], zero]), pa.int64()),
            }
        )

    return _source(docs).mapInArrow(index, "bucket int, postings binary").groupBy("bucket").applyInArrow(pairs, _FOUND)


def _bloom_places(names: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(words.mix(names.astype(np.uint64) + np.uint64(k * 0x9E3779B9)) & np.uint64(bits - 1)).astype(np.int64) for k in range(1, 4)]


def _bloom_plan(wanted: int, most_bits: int) -> tuple[int, int]:
    """Bits of a filter, and passes over the texts: BLOOM_EACH bits for each wanted set, in as many filters as that takes."""
    passes = max(1, -(-wanted * BLOOM_EACH // most_bits))
    bits = LEAST_BLOOM_BITS
    while bits < min(most_bits, wanted * BLOOM_EACH):
        bits *= 2
    return bits, passes


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, most_bits: int = MOST_BLOOM_BITS) -> DataFrame:
    """(set_id, shingles) of the sets named in ``wanted.set_id``, and of a few more that a Bloom filter lets through.

    The filter grows with the wanted sets, so that about one in a thousand of
    the others gets through however many there are. Beyond ``most_bits`` the
    wanted sets are dealt out to several filters by their names, each with a
    pass over the texts of its own.
    """
    bits, passes = _bloom_plan(wanted.count(), most_bits)
    out = None
    for turn in range(passes):
        part = _sets_in_pass(docs, wanted, shingle, bits, turn, passes)
        out = part if out is None else out.unionByName(part)
    return out


def _sets_in_pass(docs: DataFrame, wanted: DataFrame, shingle: int, bits: int, turn: int, passes: int) -> DataFrame:
    def in_turn(names: np.ndarray) -> np.ndarray:
        return words.mix(names.astype(np.uint64)) % np.uint64(passes) == turn

    def mark(batches):
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            place = np.unique(np.concatenate(_bloom_places(names[in_turn(names)], bits)))
            word, first = np.unique(place >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)), first) if len(word) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value.view(np.int64), pa.int64())], ["w", "v"])

    marked = wanted.select("set_id").mapInArrow(mark, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # bits / 64 rows at most
    bloom = np.zeros(bits // 64, np.int64)
    bloom[marked.column("w").to_numpy()] = marked.column("v").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bloom.tobytes())

    def run(batches):
        held = np.frombuffer(sent.value, np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, offs in words.chunks(batch.column(1)):
                sets = [x for x in words.shingle_sets(raw, offs, shingle) if len(x)]
                names = np.array([set_id(x) for x in sets], np.int64)
                keep = in_turn(names)
                for p in _bloom_places(names, bits):
                    keep &= (held[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
                out = []
                for i in np.flatnonzero(keep).tolist():
                    if (name := int(names[i])) not in seen:
                        seen.add(name)
                        out.append((name, sets[i].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["set_id", "shingles"])

    # equal sets of different tasks: one of them
    named = _source(docs).mapInArrow(run, "set_id long, shingles binary")
    return named.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def with_sets(docs: DataFrame, wanted: DataFrame, shingle: int, known: DataFrame | None) -> DataFrame:
    """``known`` (set_id, shingles) and the sets of ``wanted.set_id`` beyond it; texts are only read if some are missing."""
    missing = staged(wanted.distinct() if known is None else wanted.distinct().join(known, "set_id", "left_anti"), "missing")
    if missing.isEmpty():
        return known if known is not None else docs.sparkSession.createDataFrame([], "set_id long, shingles binary")
    fetched = staged(sets_of(docs, missing, shingle).join(_small(missing), "set_id", "left_semi"), "sets")
    return fetched if known is None else known.union(fetched)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets meet the threshold."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # only the sets of these pairs are moved
    near = F.broadcast if pairs.count() <= BROADCAST_LISTS else (lambda df: df)
    left = sets.withColumnsRenamed({"set_id": "a", "shingles": "x"}).join(near(pairs.select("a", "b")), "a")
    right = sets.withColumnsRenamed({"set_id": "b", "shingles": "y"}).join(near(pairs.select("b").distinct()), "b", "left_semi")
    return (
        left.join(right, "b")
        .select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    return staged(connected_components(links, "a", "b"), "labels")


def plausible(pairs: DataFrame, bitmaps: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) that their bitmaps don't refuse."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y, na, nb in zip(batch.column("x"), batch.column("y"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                size = min(len(p), len(q))
                keep.append(bool(_may_link(na, nb, int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum()), threshold)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(bitmaps.select(F.col("set_id").alias("a"), F.col("bitmap").alias("x"), F.col("n").alias("na")), "a")
        .join(bitmaps.select(F.col("set_id").alias("b"), F.col("bitmap").alias("y"), F.col("n").alias("nb")), "b")
        .select("a", "b", "x", "y", "na", "nb").mapInArrow(compare, "a long, b long")
    )


def _in_blocks(members: DataFrame, bitmaps: DataFrame, threshold: int, block: int, nearest: int | None) -> DataFrame:
    """key, a, b, more: differently labelled members of a list that their bitmaps don't refuse.

    ``members``: key, a, label, size and rest (members of the list, and those
    outside its largest group) and major (is it in that group). Of two members
    with different labels one at least is outside the largest group, so only
    those look for partners, among all. Of each the ``nearest`` come out,
    ``more`` tells if there are others; all if it is None. Seekers and members
    are cut into blocks, and every two blocks are compared in a task of their
    own, so a task's rows have a bound, and a list with few seekers few tasks.
    """
    cut = members.withColumn("rows", F.ceil(F.col("rest") / block).cast("int")).withColumn("columns", F.ceil(F.col("size") / block).cast("int"))
    own = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seekers = cut.filter("NOT major").withColumn("one", own("rows")).withColumn("two", every("columns")).withColumn("side", F.lit(0))
    all_ = cut.withColumn("two", own("columns")).withColumn("one", every("rows")).withColumn("side", F.lit(1))
    dealt = seekers.unionByName(all_).select("key", "one", "two", "side", "a", "label").join(bitmaps.select(F.col("set_id").alias("a"), "n", "bitmap"), "a")

    def compare(key, table):
        names, label, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "label", "n"))
        side = table.column("side").to_numpy()
        raw = table.column("bitmap").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        out_a, out_b, out_more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for small in np.unique(sizes).tolist():
            for large in (small, 2 * small):  # linked sets differ by less than a factor of two
                for left, right in ((small, large),) if small == large else ((small, large), (large, small)):
                    i = np.flatnonzero((sizes == left) & (side == 0))
                    j = np.flatnonzero((sizes == right) & (side == 1))
                    if not len(i) or not len(j):
                        continue
                    p = _folded(np.stack([np.frombuffer(raw[k], "<u8") for k in i]), small)
                    q = _folded(np.stack([np.frombuffer(raw[k], "<u8") for k in j]), small)
                    step = max(1, (1 << 21) // (len(j) * small))
                    for at in range(0, len(i), step):
                        rows = i[at : at + step]
                        differ = np.bitwise_count(p[at : at + step, None, :] ^ q[None, :, :]).sum(2, dtype=np.int64)
                        ok = _may_link(n[rows][:, None], n[j][None, :], differ, threshold) & (label[rows][:, None] != label[j][None, :])
                        many = np.zeros(len(rows), bool)
                        if nearest is not None:
                            many = ok.sum(1) > nearest
                            for r in np.flatnonzero(many).tolist():
                                own = np.flatnonzero(ok[r])
                                ok[r] = False
                                ok[r, own[np.argsort(differ[r, own], kind="stable")[:nearest]]] = True
                        x, y = np.nonzero(ok)
                        out_a.append(names[rows[x]])
                        out_b.append(names[j[y]])
                        out_more.append(many[x])
        a, b, more = map(np.concatenate, (out_a, out_b, out_more))
        return pa.table({"key": pa.array(np.full(len(a), key[0].as_py()), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more, pa.bool_())})

    return dealt.groupBy("key", "one", "two").applyInArrow(compare, "key long, a long, b long, more boolean")


def _gathered(lists: DataFrame) -> DataFrame:
    """key, a: long lists brought together under their least member.

    A family of near copies has a list for each of many shingles, with nearly
    the same members. All that share a least member become one, so that a
    member is looked at once for each of these, not for each shingle.
    """
    least = staged(lists.groupBy("key").agg(F.min("a").alias("least")), "least")
    return lists.join(_small(least), "key").select(F.col("least").alias("key"), "a").distinct()


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast where there are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_LISTS else keys


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """key, a, label, size, rest, major: members of the lists that aren't in one group yet."""
    named = staged(lists.join(labels.withColumnRenamed("node", "a"), "a", "left").select("key", "a", F.coalesce("component", "a").alias("label")), "named")
    spread = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"))
    spread = staged(spread.filter("size > top.n").select("key", "size", (F.col("size") - F.col("top.n")).alias("rest"), F.col("top.label").alias("top")), "spread")
    return named.join(_small(spread), "key").select("key", "a", "label", "size", "rest", (F.col("label") == F.col("top")).alias("major"))


def similarity_links(docs: DataFrame, bitmaps: DataFrame, total: int, shingle: int = SHINGLE, threshold: int = THRESHOLD, short: int = SHORT_LIST, rounds: int = NEAREST_ROUNDS, frequent_from: int = FREQUENT_FROM, block: int = BLOCK_MEMBERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links (a, b) between set ids whose components are those of all links, these components, and sets.

    Every two sets that link are either verified here, or were already joined
    by verified links when their posting list was looked at. ``bitmaps`` has
    set_id, n and bitmap of every set, ``total`` is their number of shingles.
    Also returns the components (node, component) and the sets (set_id,
    shingles) fetched for that: those of the pairs verified. The members of long
    lists aren't, as few of them are ever compared.
    """
    frequent = frequent_codes(docs, total, shingle, frequent_from)
    found = staged(candidates(docs, frequent, total, shingle, threshold, short), "candidates")
    tried = staged(plausible(_ordered(found.filter("kind = 0")), bitmaps, threshold), "pairs")
    lists = staged(_gathered(found.filter("kind = 1").select("key", "a")), "lists")
    sets = with_sets(docs, tried.select(F.explode(F.array("a", "b")).alias("set_id")), shingle, None)
    links = staged(verified(tried, sets, threshold), "links")
    labels = _labels(links)
    if lists.isEmpty():
        return links, labels, sets
    nearest = NEAREST if rounds > 0 else None
    while True:
        open_ = staged(_open_lists(lists, labels), "open")
        if open_.isEmpty():
            return links, labels, sets
        pairs = staged(_in_blocks(open_, bitmaps, threshold, block, nearest), "partners")
        new = staged(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), "pairs")
        merged = False
        if not new.isEmpty():
            sets = with_sets(docs, new.select(F.explode(F.array("a", "b")).alias("set_id")), shingle, sets)
            more = staged(verified(new, sets, threshold), "links")
            tried = staged(tried.union(new), "tried")
            if merged := not more.isEmpty():
                links = staged(links.union(more), "links")
                # groups so far are stars already, so this settles in a few rounds
                labels = _labels(labels.toDF("a", "b").union(more))
        again = staged(pairs.filter("more").select("key").distinct(), "again")
        if again.isEmpty():  # all that may link was compared
            return links, labels, sets
        lists = staged(lists.join(_small(again), "key", "left_semi"), "lists")
        rounds -= 1
        nearest = NEAREST if merged and rounds > 0 else None


def _shared(xs: list[np.ndarray], ys: list[np.ndarray], alone: bool):
    """For some of ``xs`` at a time: their first index, and how many shingles each shares with each of ``ys``; a product of incidence matrices, some columns at a time. If the two are the same, a set's count with itself means nothing."""
    nx, ny = (np.array([len(x) for x in part], np.int64) for part in (xs, ys))
    code, column = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    split = int(nx.sum())
    in_x, in_y = (np.bincount(c, minlength=len(code)) for c in (column[:split], column[split:]))
    everywhere = (in_x == len(xs)) & (in_y == len(ys))
    used = (in_x > alone) & (in_y > 0) & ~everywhere  # only these tell pairs apart
    number = np.cumsum(used) - 1

    def by_column(part: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = used[part]
        order = np.argsort(number[part[keep]], kind="stable")
        return of[keep][order], number[part[keep]][order]

    row_y, col_y = by_column(column[split:], np.repeat(np.arange(len(ys)), ny))
    ends = np.cumsum(nx)
    for at in range(0, len(xs), STRIP):
        n = min(STRIP, len(xs) - at)
        row_x, col_x = by_column(column[ends[at] - nx[at] : ends[at + n - 1]], np.repeat(np.arange(n), nx[at : at + n]))
        out = np.full((n, len(ys)), float(everywhere.sum()), np.float32)
        for lo in range(0, int(used.sum()), COLUMNS):
            a, b = np.searchsorted(col_x, (lo, lo + COLUMNS))
            if a == b:
                continue
            one = np.zeros((n, COLUMNS), np.float32)
            one[row_x[a:b], col_x[a:b] - lo] = 1
            a, b = np.searchsorted(col_y, (lo, lo + COLUMNS))
            two = np.zeros((len(ys), COLUMNS), np.float32)
            two[row_y[a:b], col_y[a:b] - lo] = 1
            out += one @ two.T
        yield at, out


def link_counts(labels: DataFrame, bitmaps: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, tile: int = TILE_BYTES) -> DataFrame:
    """set_id, n_links: how many other sets each set of a group links to.

    Sets that link are in one group (``labels``: node, component), so all pairs
    of a group, and no others, are intersected exactly. Groups are cut into
    tiles; a tile of two blocks of a group is one task's work and sends a count
    for each of its sets. Small groups share tasks.
    """
    named = labels.withColumnRenamed("node", "set_id").join(bitmaps.select("set_id", "n"), "set_id")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum("n")).alias("bytes"))
    # a group of any size is joined where its members are, unless there are very many groups
    members = staged(named.join(_small(staged(sizes, "sizes")), "component").select("set_id", "component", "size", "bytes", "n"), "members")
    many, total = members.filter("size > 2").agg(F.count(F.lit(1)), F.coalesce(8 * F.sum("n"), F.lit(0))).first()
    buckets = max(1, total // tile)
    small = F.col("bytes") <= tile
    cut = members.filter("size > 2").withColumn("blocks", F.ceil(F.col("bytes") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component")).alias("part"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        F.when(small, F.lit(0)).otherwise(F.lit(1)).alias("large"), "component", (F.col("own") > F.col("other")).cast("int").alias("side"), "set_id",
    )

    def count(key, table):
        name, component, side = (table.column(c).to_numpy() for c in ("set_id", "component", "side"))
        raw = table.column("shingles")
        alone = key[2].as_py() == key[3].as_py()
        order = np.argsort(component, kind="stable")
        ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts, many = _runs(component[order])
        for at, m in zip(starts.tolist(), many.tolist(), strict=True):
            own = order[at : at + m]
            i, j = (own, own) if alone else (own[side[own] == 0], own[side[own] == 1])
            if not len(i) or not len(j):
                continue
            xs, ys = ([np.frombuffer(raw[int(k)].as_buffer(), "<u8") for k in part] for part in (i, j))
            nx, ny = (np.array([len(x) for x in part], np.int64) for part in (xs, ys))
            across = np.zeros(len(ys), np.int64)
            for at, both in _shared(xs, ys, alone):
                ok = (100 + threshold) * both >= threshold * (nx[at : at + len(both), None] + ny[None, :])
                ids.append(name[i[at : at + len(both)]])
                if alone:
                    ok[np.arange(len(ok)), at + np.arange(len(ok))] = False
                links.append(ok.sum(1))
                across += ok.sum(0)
            if not alone:
                ids.append(name[j])
                links.append(across)
        return pa.table({"set_id": pa.array(np.concatenate(ids), pa.int64()), "n_links": pa.array(np.concatenate(links), pa.int64())})

    counted = sets.join(F.broadcast(dealt) if many <= BROADCAST_MEMBERS else dealt, "set_id").groupBy("part", "large", "one", "two").applyInArrow(count, "set_id long, n_links long")
    pairs = members.filter("size = 2").select("set_id", F.lit(1).cast("long").alias("n_links"))
    return counted.union(pairs).groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


def _classes(docs: DataFrame, shingle: int, threshold: int, count: bool, **how) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and set_id, component, n_copies (and n_links) of every set."""
    docs_sets = staged(document_sets(docs, shingle), "document-sets")
    total = docs_sets.agg(F.sum("n_shingles")).first()[0] or 0
    bitmaps = staged(docs_sets.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")), "bitmaps")
    _, labels, sets = similarity_links(docs, bitmaps, total, shingle, threshold, **how)
    classes = docs_sets.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    grouped = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    if count:
        sets = with_sets(docs, labels.select(F.col("node").alias("set_id")), shingle, sets)
        grouped = grouped.join(link_counts(labels, bitmaps, sets, threshold), "set_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return docs_sets, staged(grouped, "groups")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, n_links of every row.

    ``component_id`` is the smallest doc_id that links reach, ``n_copies`` the
    rows with the very same set, ``n_links`` the other sets that the set links
    to. Null and blank texts have an empty set, link to nothing and are their
    own component. Rows with one doc_id and equal sets come out as often as they
    came in. Rows with a null doc_id give their sets to the groups, and are
    named by the smallest other id of theirs, or null. Texts of any length count
    with all their shingles; an empty table gives an empty result; other columns
    of ``docs``, whatever their names, are left alone.
    """
    docs_sets, grouped = _classes(docs, shingle, threshold, True, **how)
    # only groups of several sets need their smallest member looked up
    roots = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("root"))
    named = grouped.join(roots, "component", "left").select("set_id", F.coalesce("root", "least").alias("component_id"), "n_copies", "n_links")
    return docs_sets.join(named, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _row_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the id (null last) and the text's digest. Rows equal in both have equal texts."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("__null"), F.coalesce(doc_id, F.lit(0)).alias("__id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("__digest")]


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` without the near copies, with all their columns.

    Of each group the row with the smallest doc_id stays, null ids last; of rows
    of a group with one id that with the smallest md5 of its text, and of rows
    equal in both one of them. Ids needn't be unique: a row goes only for what
    its own text links to. Rows with a null or blank text all stay. Columns
    named __null, __id and __digest must not be in ``docs``.
    """
    keyed = docs.select("doc_id", "text", *_row_key(docs))
    docs_sets, grouped = _classes(keyed, shingle, threshold, False, **how)
    rows = docs_sets.filter("set_id IS NOT NULL").groupBy("set_id", "__null", "__id", "__digest").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows.join(grouped.select("set_id", F.coalesce("component", "set_id").alias("component")), "set_id"), "rows")
    key = F.struct("__null", "__id", "__digest")
    stays = rows.groupBy("component").agg(F.min(key).alias("stays"))
    judged = rows.join(stays, "component").withColumn("kept", key == F.col("stays"))
    judged = staged(judged.filter("NOT kept OR n > 1").select("__null", "__id", "__digest", "kept"), "judged")
    names = ["__null", "__id", "__digest"]
    out = docs.withColumns(dict(zip(names, _row_key(docs), strict=True)))
    # texts aren't moved while the rows to leave out are few enough to be broadcast
    single = out.join(_small(judged.select(names)), names, "left_anti")
    twice = judged.filter("kept").select(names)
    if twice.isEmpty():
        return single.select(*docs.columns)
    # equal rows of which one stays; each task sends one at most of each
    one = out.join(_small(twice), names, "left_semi").dropDuplicates(names)
    return single.union(one).select(*docs.columns)


#: DuckDB SQL for ``similar_groups`` over ``documents`` with unique doc_id: all pairs of sets with a common shingle.
GROUPS_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
token AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS words FROM doc),
run AS (SELECT doc_id, words, i, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS x FROM token),
named AS (
  SELECT doc_id, len(s) AS n, s, md5(array_to_string(s, ',')) AS id
  FROM (SELECT doc_id, coalesce(s, []) AS s FROM documents LEFT JOIN (SELECT doc_id, list_sort(list_distinct(list(hash(x)))) AS s FROM run WHERE i <= greatest(words - {SHINGLE - 1}, 1) GROUP BY doc_id) USING (doc_id))
),
class AS (SELECT id, min(doc_id) AS least, count(*) AS n_copies, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY id),
entry AS (SELECT id, n, unnest(s) AS g FROM class),
link AS (SELECT a.id AS x, b.id AS y FROM entry a JOIN entry b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
reach AS (SELECT id, least FROM class UNION SELECT y, least FROM reach JOIN link ON x = id),
root AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id),
degree AS (SELECT x AS id, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, CAST(named.n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM named LEFT JOIN root ON named.id = root.id AND named.n > 0 LEFT JOIN class ON named.id = class.id LEFT JOIN degree ON named.id = degree.id
"""
