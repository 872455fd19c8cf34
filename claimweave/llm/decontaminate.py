"""Benchmark decontamination with suffix arrays over the training text.

Every chunk of training documents is a shard. Its suffix array is binary-
searched for all test suffixes at once, word by word, which gives each one's
longest verbatim match and the range of the array that has all its places.
Ranges are marked on the array, never written out as pairs of places, so a
shard takes memory in proportion to its words, however often they repeat. Only
suffixes of words that all occur in the benchmark are sorted. A document lies
whole in one shard, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import words

#: Words in one window of an item; a shorter item is one window itself.
WINDOW = 13
#: Words of test items that are sent to the tasks at once; with more, suspects are searched for once and then block by block.
BLOCK_WORDS = 2_000_000
#: Bits of the Bloom filter of all windows that finds the suspects, at most; a full one lets more through.
BLOOM_BITS = 1 << 29
#: Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 32 * words.CHUNK

_ROW = "__row_of_texts"  # tells rows apart that are equal, or have no id
_MATCHES = "n_words long, n_hit long, hits binary, items array<string>"


@dataclass
class Items:
    """A block of test items, as every task gets it."""

    ids: list[str]
    tokens: np.ndarray  # dense word numbers of all items, 1.. ; a 0 after each
    owner: np.ndarray  # item of each token
    left: np.ndarray  # words from each token to its item's end
    vocabulary: np.ndarray  # sorted word hashes; number = place + 1
    at: np.ndarray  # a place of each different window
    need: np.ndarray  # its words
    group: np.ndarray  # the set of items that have it
    first: np.ndarray  # first entry of each set in ``members``, sets + 1
    members: np.ndarray  # item numbers

    @property
    def least(self) -> int:
        return int(self.need.min()) if len(self.need) else 1


def _tokenised(benchmark: DataFrame) -> DataFrame:
    """i (a null id is the name '') and tokens (word hashes) of every item, written once."""

    def run(batches):
        for batch in batches:
            texts = (np.frombuffer(x.encode(), np.uint8) for x in batch.column(1).to_pylist())
            tokens = [words.words_of(raw, np.array([0, len(raw)]), words.ALNUM)[0].astype("<u8").tobytes() for raw in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["i", "tokens"])

    rows = benchmark.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in (("item_id", "i"), ("text", "t"))))
    return staged(rows.mapInArrow(run, "i string, tokens binary"), "items")


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Items]:
    """The items in blocks of bounded size, read one partition at a time."""
    ids: list[str] = []
    texts: list[np.ndarray] = []
    held = 0
    for row in items.toLocalIterator():
        tokens = np.frombuffer(row.tokens, "<u8")
        if held and held + len(tokens) > block_words:
            yield _block(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(tokens)
        held += len(tokens)
    yield _block(ids, texts, window)


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The test items in blocks of bounded size, tokenised in tasks; one empty block if there are none."""
    return _blocks(_tokenised(benchmark), window, block_words)


def _classes(tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A number for each of the runs of ``k`` tokens beginning ``at``, the same for equal ones: ranks of doubled length, two of which cover the run."""
    rank, step = tokens.astype(np.int64), 1
    while 2 * step <= k:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    pair = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + k - step]
    return np.unique(pair, return_inverse=True)[1]


def _block(ids: list[str], texts: list[np.ndarray], window: int) -> Items:
    sizes = np.array([len(x) for x in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
    vocabulary = np.unique(flat)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    left = sizes[owner] - place
    tokens = np.zeros(len(owner), np.int64)
    tokens[left > 0] = np.searchsorted(vocabulary, flat) + 1
    need = np.minimum(window, sizes)[owner]
    begins = np.flatnonzero((left >= need) & (left > 0))
    at, needs, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sets: dict[bytes, int] = {}
    for k in np.unique(need[begins]).tolist():
        own = begins[need[begins] == k]
        kind = _classes(tokens, own, k)
        pairs = np.unique(kind * len(sizes) + owner[own])  # each window's items
        cut = np.flatnonzero(np.diff(pairs // len(sizes), prepend=-1))
        of = np.split((pairs % len(sizes)).astype("<i8"), cut[1:])
        at.append(own[np.unique(kind, return_index=True)[1]])
        needs.append(np.full(len(cut), k))
        groups.append(np.array([sets.setdefault(x.tobytes(), len(sets)) for x in of], np.int64))
    lists = [np.frombuffer(x, "<i8") for x in sets]
    return Items(
        ids, tokens, owner, left, vocabulary, np.concatenate(at), np.concatenate(needs), np.concatenate(groups),
        np.cumsum([0, *(len(x) for x in lists)]), np.concatenate([*lists, np.zeros(0, np.int64)]),
    )


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` tokens that follow each; prefix doubling, ties in order of place.

    ``tokens`` must be 0 after each text, so that no match runs on into the next.
    """
    n = len(tokens)
    rank = tokens.astype(np.int64)
    step = 1
    while step < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        ahead[tokens == 0] = 0
        rank = np.where(tokens == 0, 0, rank)
        _, rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)
        rank = np.where(tokens == 0, 0, rank + 1)
        step *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def search(tokens: np.ndarray, array: np.ndarray, queries: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of the suffixes of ``queries`` beginning ``at``, for ``most`` words each.

    Returns each one's matched length and the range of ``array`` that has it.
    """
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero((most > 0) & (len(array) > 0))
    d = 0
    while len(live):
        want = queries[at[live] + d]
        ends = []
        for side in (0, 1):  # first place not below, then first place above
            left, right = lo[live].copy(), hi[live].copy()
            while (open_ := left < right).any():
                mid = (left + right) // 2
                have = tokens[np.minimum(array[np.minimum(mid, len(array) - 1)] + d, len(tokens) - 1)]
                go = (have < want) | ((have == want) & (side == 1))
                left = np.where(open_ & go, mid + 1, left)
                right = np.where(open_ & ~go, mid, right)
            ends.append(left)
        found = ends[1] > ends[0]
        live = live[found]
        lo[live], hi[live] = ends[0][found], ends[1][found]
        d += 1
        length[live] = d
        live = live[most[live] > d]
    return length, lo, hi


@dataclass
class Shard:
    """The words of a chunk of texts that can match, laid out for a suffix array."""

    first: np.ndarray  # first word of each row in the chunk, rows + 1
    tokens: np.ndarray  # runs of words that all occur in the items, a 0 after each
    where: np.ndarray  # places of ``tokens`` that are words
    origin: np.ndarray  # the chunk's word at each place
    row: np.ndarray  # and its row


def _laid_out(items: Items, raw: np.ndarray, offs: np.ndarray, least: int) -> Shard:
    """Runs of at least ``least`` words of the vocabulary, within one row each."""
    table = np.zeros(1 << 16, bool)
    table[(items.vocabulary >> np.uint64(48)).astype(np.int64)] = True
    hashes, first = words.words_of(raw, offs, words.ALNUM)
    maybe = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    spot = np.searchsorted(items.vocabulary, hashes[maybe])
    spot[spot == len(items.vocabulary)] = 0
    real = items.vocabulary[spot] == hashes[maybe] if len(items.vocabulary) else np.zeros(len(maybe), bool)
    maybe, spot = maybe[real], spot[real]
    row = np.searchsorted(first, maybe, "right") - 1
    fresh = np.ones(len(maybe), bool)
    fresh[1:] = (np.diff(maybe) != 1) | (np.diff(row) != 0)
    run = np.cumsum(fresh) - 1
    keep = np.bincount(run, minlength=1)[run] >= least
    maybe, spot, row, run = maybe[keep], spot[keep], row[keep], run[keep]
    shift = np.cumsum(np.diff(run, prepend=run[:1]) != 0)
    where = np.arange(len(maybe)) + shift
    size = int(where[-1]) + 2 if len(where) else 1
    tokens, origin, of_row = (np.zeros(size, np.int64) for _ in range(3))
    tokens[where], origin[where], of_row[where] = spot + 1, maybe, row
    return Shard(first, tokens, where, origin, of_row)


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The members of the ranges, one after another."""
    return np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)


def _scan(items: Items, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[list[str]]]:
    """Per row of one shard: words, hit words, ranges of hit words, items."""
    shard = _laid_out(items, raw, offs, items.least)
    first, rows = shard.first, len(offs) - 1
    n_words = np.diff(first)
    change = np.zeros(int(first[-1]) + 1, np.int64)
    owned = [np.zeros(0, np.int64)]
    if len(shard.where) and len(items.at):
        array = suffix_array(shard.tokens, shard.where, int(items.need.max()))
        # a window of which a word doesn't occur can't match
        here = np.zeros(len(items.vocabulary) + 1, bool)
        here[shard.tokens] = True
        absent = np.cumsum(np.append(0, ~here[items.tokens]))
        try_ = np.flatnonzero(absent[items.at + items.need] == absent[items.at])
        length, lo, hi = search(shard.tokens, array, items.tokens, items.at[try_], items.need[try_])
        for k in np.unique(items.need[try_]).tolist():
            # ranges of different windows of one length don't overlap: no more entries than words
            ok = (length == k) & (items.need[try_] == k)
            size = (hi - lo)[ok]
            places = array[_spread(lo[ok], size)]
            change[shard.origin[places]] += 1
            change[shard.origin[places] + k] -= 1
            owned.append(np.unique(shard.row[places] * len(items.first) + np.repeat(items.group[try_][ok], size)))
    hit = np.cumsum(change)[:-1] > 0
    n_hit = np.diff(np.append(0, np.cumsum(hit))[first])
    begins = hit.copy()
    begins[1:] &= ~hit[:-1]
    filled = first[:-1][n_words > 0]
    begins[filled] = hit[filled]
    ends = hit.copy()
    ends[:-1] &= ~hit[1:]
    last = first[1:][n_words > 0] - 1
    ends[last] = hit[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    spans, names = [b""] * rows, [[] for _ in range(rows)]
    pairs = np.unique(np.concatenate(owned))
    row, group = pairs // len(items.first), pairs % len(items.first)
    cut, edge = np.searchsorted(row, np.arange(rows + 1)), np.searchsorted(starts, first)
    for r in np.flatnonzero(n_hit).tolist():
        a, b = edge[r], edge[r + 1]
        spans[r] = (np.stack([starts[a:b], stops[a:b]], 1) - first[r]).astype("<i8").tobytes()
        own = group[cut[r] : cut[r + 1]]
        found = np.unique(items.members[_spread(items.first[own], items.first[own + 1] - items.first[own])])
        names[r] = sorted({items.ids[i] for i in found.tolist()})
    return n_words, n_hit, spans, names


def _over(rows: DataFrame, items: Items, keep: str, hit_only: bool = False):
    """One pass: the column ``keep`` and the matches of each row, or of each that is hit; and the broadcast block."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for batch in batches:
            for lo, hi, raw, offs in words.chunks(batch.column(1), SHARD_BYTES):
                n_words, n_hit, spans, names = _scan(sent.value, raw, offs)
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(arrays, [keep, "n_words", "n_hit", "hits", "items"])
                yield out.filter(pa.array(n_hit > 0, pa.bool_())) if hit_only else out

    source = rows.select(F.col(keep).cast("long").alias(keep), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"{keep} long, {_MATCHES}"), sent


def _window_hashes(hashes: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the hashes of the runs of so many words, and their rows; none runs on into the next row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in sizes:
        run = words.joined(hashes, k)
        inside = row[: len(run)] == row[k - 1 :] if len(run) else np.zeros(0, bool)
        yield k, run[inside], row[: len(run)][inside]


def _bloom_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(words.mix(hashes + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3)]


def _window_bloom(items: DataFrame, window: int, n: int) -> tuple[list[int], np.ndarray]:
    """The sizes of windows, and a Bloom filter of all windows, as bits."""
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    sizes = [r.k for r in items.filter("length(tokens) > 0").select(F.least(F.lit(window), (F.length("tokens") / 8).cast("int")).alias("k")).distinct().collect()]

    def mark(batches):
        flags = np.zeros(bits, np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tokens = np.frombuffer(x, "<u8")
                if len(tokens):
                    for p in _bloom_places(words.joined(tokens, min(window, len(tokens))), bits):
                        flags[p] = 1
        packed = np.packbits(flags, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["w", "v"])

    table = items.select("tokens").mapInArrow(mark, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # bits / 64 rows at most
    bloom = np.zeros(bits // 64, np.int64)
    bloom[table["w"].to_numpy(np.int64)] = table["v"].to_numpy(np.int64)
    return sizes, bloom


def _suspicion(sizes: list[int], bloom: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and whether it may have a window."""
    bits = np.unpackbits(bloom.view(np.uint8), bitorder="little")
    hashes, first = words.words_of(raw, offs, words.ALNUM)
    out = np.zeros(len(offs) - 1, bool)
    for _, run, row in _window_hashes(hashes, first, sizes):
        ok = np.ones(len(run), bool)
        for p in _bloom_places(run, len(bits)):
            ok &= bits[p] == 1
        out[row[ok]] = True
    return np.diff(first), out


def _found_in_blocks(suspects: DataFrame, blocks: Iterator[Items]) -> DataFrame:
    """_ROW, n_hit, hits, items of the suspects that are hit; one block is held at a time, its hits are written."""
    out = None
    for items in blocks:
        found, sent = _over(suspects, items, _ROW, hit_only=True)
        found = staged(found.drop("n_words", "n_hit"), "hits")
        sent.destroy()
        out = found if out is None else out.union(found)

    def disjoint(batches):
        for batch in batches:
            spans, n = [], []
            for x in batch.column(1).to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                head = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
                merged = np.stack([pairs[head, 0], reach[np.append(head[1:], len(pairs)) - 1]], 1)
                spans.append(merged.astype("<i8").tobytes())
                n.append(int((merged[:, 1] - merged[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.binary()), batch.column(2)], [_ROW, "n_hit", "hits", "items"])

    grouped = out.groupBy(_ROW).agg(F.unhex(F.array_join(F.collect_list(F.hex("hits")), "")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return grouped.mapInArrow(disjoint, f"{_ROW} long, n_hit long, hits binary, items array<string>")


def _words_in(items: DataFrame) -> int:
    return (items.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 8


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, hits, items.

    ``hits`` is the list of disjoint hit word ranges as little-endian int64
    pairs, ``items`` the sorted ids of the items with an occurring window (the
    name '' for a null id). A null or empty text has no words, a null id stays
    null, and an item without words has no window. Each row is judged on its
    own, however many items there are: repeated rows give repeated results. An
    empty benchmark leaves every document clean. Columns of ``docs`` other than
    doc_id and text are left alone, whatever their names. Texts of any length
    are searched whole, in memory in proportion to the longest.

    Up to ``block_words`` words of items are one block and one pass. With more,
    one pass over all rows looks their windows up in a Bloom filter of all of
    the items' windows and writes the texts of the rows that may have one; only
    these are then searched, block by block.
    """
    items = _tokenised(benchmark)
    n = _words_in(items)
    if n <= block_words:
        return _over(docs, next(_blocks(items, window, block_words)), "doc_id")[0]
    sizes, bloom = _window_bloom(items, window, n)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def look(batches):
        for batch in batches:
            for lo, hi, raw, offs in words.chunks(batch.column(1), SHARD_BYTES):
                n_words, maybe = _suspicion(sizes, sent.value, raw, offs)
                text = batch.column(1).slice(lo, hi - lo).to_pylist()
                kept = pa.array([t if m else None for t, m in zip(text, maybe.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), kept], ["doc_id", "n_words", "text"])

    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(look, "doc_id long, n_words long, text string")
    rows = staged(looked.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    found = _found_in_blocks(rows.filter("text IS NOT NULL").select(_ROW, "text"), _blocks(items, window, block_words))
    none = F.array().cast("array<string>")
    return rows.select(_ROW, "doc_id", "n_words").join(found, _ROW, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hits", F.lit(b"")).alias("hits"), F.coalesce("items", none).alias("items"))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row, as ``verbatim_matches`` finds them.

    A document is contaminated if a twentieth of its words or more are hit.
    """
    return verbatim_matches(docs, benchmark, window, block_words).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, each judged on its own.

    One pass without a shuffle where the items are one block. With more, rows
    that have no window by the Bloom filter stay as they are; the others are
    numbered, written and searched block by block.
    """
    items = _tokenised(benchmark)
    n = _words_in(items)
    if not n:
        return docs
    text = docs.columns.index("text")
    context = docs.sparkSession.sparkContext
    if n <= block_words:
        sent = context.broadcast(next(_blocks(items, window, block_words)))

        def run(batches):
            for batch in batches:
                for lo, hi, raw, offs in words.chunks(batch.column(text), SHARD_BYTES):
                    n_words, n_hit, _, _ = _scan(sent.value, raw, offs)
                    yield batch.slice(lo, hi - lo).filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words)), pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    sizes, bloom = _window_bloom(items, window, n)
    filter_ = context.broadcast(bloom)

    def those(wanted: bool) -> DataFrame:
        def pick(batches):
            for batch in batches:
                for lo, hi, raw, offs in words.chunks(batch.column(text), SHARD_BYTES):
                    yield batch.slice(lo, hi - lo).filter(pa.array(_suspicion(sizes, filter_.value, raw, offs)[1] == wanted, pa.bool_()))

        return docs.mapInArrow(pick, docs.schema)

    rows = staged(those(True).withColumn(_ROW, F.monotonically_increasing_id()), "suspects")
    found = _found_in_blocks(rows.select(_ROW, "text"), _blocks(items, window, block_words))
    sized = rows.select(_ROW, F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).alias("n_words"))
    bad = sized.join(found, _ROW).filter(_contaminated(F.col("n_hit"), F.col("n_words"))).select(_ROW)
    return those(False).union(rows.join(bad, _ROW, "left_anti").select(*docs.columns))


def suffix_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, item_word, length, n_places, doc_id, doc_word: the longest verbatim match of every test suffix.

    A suffix begins at the item's word ``item_word`` (from 0); ``length`` is the
    most of its words that stand one after another in any document, ``n_places``
    how often they do, doc_id and doc_word where they do first (a null doc_id is
    last). Suffixes of which fewer than ``least`` words match are left out; a
    larger ``least`` sorts and sends less. Each task sends a row for each suffix
    it has found, so this grows with tasks and test words. Items with one id are
    told apart by nothing: their suffixes are looked at together.
    """
    out = None
    for items in _blocks(_tokenised(benchmark), WINDOW, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            size = len(items.tokens)
            best, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
            # the first place: is the id null, id, word
            place = np.zeros((3, size), np.int64)
            for batch in batches:
                ids = batch.column(0)
                null = np.array([not x for x in ids.is_valid().to_pylist()], np.int64)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for low, high, raw, offs in words.chunks(batch.column(1), SHARD_BYTES):
                    shard = _laid_out(items, raw, offs, least)
                    if not len(shard.where):
                        continue
                    array = suffix_array(shard.tokens, shard.where, int(items.left.max()))
                    here = np.zeros(len(items.vocabulary) + 1, bool)
                    here[shard.tokens] = True
                    at = np.flatnonzero(here[items.tokens] & (items.left > 0))
                    length, lo, hi = search(shard.tokens, array, items.tokens, at, items.left[at])
                    # rows by id, null last; rows with one id share a rank
                    named, rank = np.unique(np.stack([null[low:high], ids[low:high]], 1), axis=0, return_inverse=True)
                    rank = rank.ravel()
                    code = np.append((rank[shard.row[array]] << 32) + shard.origin[array] - shard.first[shard.row[array]], 0)
                    fit = length >= np.maximum(least, best[at])
                    at, length, lo, hi = at[fit], length[fit], lo[fit], hi[fit]
                    if not len(at):
                        continue
                    ranges, inverse = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
                    first = np.minimum.reduceat(code, ranges.ravel())[::2][inverse.ravel()]
                    new = np.stack([*named[first >> 32].T, first & 0xFFFFFFFF])
                    same = length == best[at]
                    old = place[:, at]
                    # column-wise comparison of (null, id, word)
                    earlier = (new[0] < old[0]) | ((new[0] == old[0]) & ((new[1] < old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))
                    take = ~same | earlier
                    place[:, at[take]] = new[:, take]
                    count[at] = np.where(same, count[at], 0) + hi - lo
                    best[at] = length
            at = np.flatnonzero(best)
            begin = np.flatnonzero(np.diff(items.owner, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([items.ids[i] for i in items.owner[at].tolist()], pa.string()), pa.array(at - begin[items.owner[at]], pa.int64()), pa.array(best[at], pa.int64()), pa.array(count[at], pa.int64()),
                    pa.array(place[0][at] == 1, pa.bool_()), pa.array(place[1][at], pa.int64()), pa.array(place[2][at], pa.int64()),
                ],
                ["item_id", "item_word", "length", "n_places", "no_id", "doc_id", "doc_word"],
            )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = staged(rows.mapInArrow(run, "item_id string, item_word long, length long, n_places long, no_id boolean, doc_id long, doc_word long"), "suffixes")
        sent.destroy()
        out = found if out is None else out.union(found)
    each = out.groupBy("item_id", "item_word", "length").agg(F.sum("n_places").alias("n_places"), F.min(F.struct("no_id", "doc_id", "doc_word")).alias("place"))
    best = each.groupBy("item_id", "item_word").agg(F.max(F.struct("length", "n_places", "place")).alias("m"))
    place = F.col("m.place")
    return best.select("item_id", "item_word", "m.length", "m.n_places", F.when(~place["no_id"], place["doc_id"]).alias("doc_id"), place["doc_word"].alias("doc_word"))


_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: DuckDB SQL for ``contamination`` over ``documents`` and ``benchmark`` with unique, non-null ids.
CONTAMINATION_SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
placed AS (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS x FROM placed),
held AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, item, i, k FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM held) JOIN win USING (k, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
