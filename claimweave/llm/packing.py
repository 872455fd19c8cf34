"""Best-fit packing: sequences are planned on a histogram of lengths, documents take the planned slots by their rank within a length."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Tokens of a sequence at most, and the id that ends a document.
SEQUENCE, END = 1024, 2
#: Characters of a text that are tokenised at once, about.
CHUNK = 1 << 16
#: Rows (one for each task and length in it) up to which the table of first ranks is broadcast.
BROADCAST_RANKS = 200_000
#: Bits of a rank in the key that finds its slot.
_RANK_BITS = 48

#: Fixed value: how the vocabulary's byte-level tokenizer splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Run:
    """Slots of one length: those of ranks from ``first_rank`` on, ``each`` to a sequence, side by side from ``offset``."""

    length: int
    first_rank: int
    slots: int
    each: int
    first_sequence: int
    offset: int


def planned(counts: dict[int, int], size: int = SEQUENCE) -> tuple[list[Run], int]:
    """Best fit over a histogram (length to count), longest first: the runs of slots, and how many sequences there are.

    Equal pieces are placed together: the fullest sequences that still have
    room take as many of them as fit, which is what best fit does one by one.
    A run halves the room of its sequences at least and a length opens or cuts
    three groups of them at most, so there are at most ``3 * size * log2(size)``
    runs, however many pieces there are.
    """
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens to groups of sequences: first one, how many
    free: list[int] = []  # the keys of room, in order
    sequences = 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, many))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens fits no sequence of {size}")
        rest, rank = counts[length], 0
        while rest:
            at = bisect_left(free, length)
            if at == len(free):
                many = -(-rest // (size // length))
                put(size, sequences, many)
                sequences += many
                continue
            left = free[at]
            first, many = room[left].pop()
            if not room[left]:
                del room[left], free[at]
            each = left // length
            full = min(many, rest // each)
            if not full:  # the last few pieces of this length
                each, full = rest, 1
            runs.append(Run(length, rank, full * each, each, first, size - left))
            put(left - each * length, first, full)
            put(left, first + full, many - full)
            rank, rest = rank + full * each, rest - full * each
    return runs, sequences


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, in order of merging, from the file of a byte-level tokenizer; its special tokens left out."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    # such files write each byte as a character: printable ones as they are, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in held["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}


def parts_of(text: str, limit: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters that can be tokenised one by one.

    A cut is before a blank between two letters: no token of the pattern goes
    over it. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > limit:
        cut = re.compile("[a-z] [a-z]").search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def encoder(ranks: dict[bytes, int]):
    """A function from a text to its ids (unsigned 32-bit); strings of special tokens in it are ordinary text."""
    import tiktoken

    coder = tiktoken.Encoding("claimweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        return np.concatenate([np.array(coder.encode_ordinary(part), "<u4") for part in parts_of(text)])

    return ids


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, part, nth, and ids if asked for.

    A document's ids end with ``end``; where there are more than ``size``, they
    are cut into pieces of ``size``, of which the first takes what is over.
    ``part`` is the task and ``nth`` the piece's number among those of its
    length there: both hold only once the rows are written.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # one vocabulary
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]

    def run(batches):
        ids_of, part, seen = encoder(sent.value), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end)).astype("<u4")
                start, stop = 0, len(ids) % size or size
                for piece in range(-(-len(ids) // size)):
                    own = ids[start:stop]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)], *([own.astype(np.int32)] if keep_ids else [])))
                    seen[len(own)] += 1
                    start, stop = stop, stop + size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids if asked for.

    Best fit decreasing, planned on the histogram of lengths (``size`` numbers
    on the driver) and not on documents. A piece's rank among those of its
    length is its number in its task plus what earlier tasks have, so no length
    is gathered or sorted anywhere, however many pieces share it; the rank
    gives its place in the plan, a bounded table. Null text is empty: one
    ``end``. Rows with equal or null ids are packed each on its own; an empty
    table gives an empty result; other columns are left out, whatever their
    names. Texts of any length are tokenised whole.
    """
    made = staged(pieces(docs, path, size, end, keep_ids), "pieces")
    counted = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    first = staged(counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "first-ranks")
    counts = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    runs, _ = planned(counts, size)
    runs.sort(key=lambda r: (r.length, r.first_rank))
    table = np.array([((r.length << _RANK_BITS) + r.first_rank, r.first_rank, r.each, r.first_sequence, r.offset) for r in runs], np.int64).reshape(-1, 5).T
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = [*made.columns[:5], "sequence_id", "offset", *(["ids"] if keep_ids else [])]

    def run(batches):
        key, first_rank, each, sequence, offset = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key, (length << _RANK_BITS) + rank, "right") - 1
            of = rank - first_rank[k]
            out = {"sequence_id": pa.array(sequence[k] + of // each[k]), "offset": pa.array(offset[k] + of % each[k] * length)}
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in names], names)

    small = first.count() <= BROADCAST_RANKS
    ranked = made.join(F.broadcast(first.drop("n")) if small else first.drop("n"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return ranked.drop("part", "nth", "first").mapInArrow(run, schema)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of every sequence of ``packed(..., keep_ids=True)``: its pieces' ids side by side, and whose they are."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # as many as a sequence has tokens, at most
    return pieces_with_ids.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))
