"""Word and shingle hashes of many texts at once, with numpy over Arrow buffers.

Texts are read as UTF-8 bytes. Every byte of a non-ASCII character is 0x80 or
more, so the two word classes used here are classes of bytes:

* ``SPACED``: ``[^\\x20\\x09-\\x0D]+``
* ``ALNUM``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z

Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a task, not what it covers. Spark bounds the bytes of the Arrow batches themselves.
CHUNK = 1 << 17

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C13
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, bytes, and each row's offsets in them.

    Null is the empty text. A row larger than the limit comes alone and whole.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (rows + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = kind[_FOLD[raw]]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of each word; A-Z lower-cased, unless ``fold`` is false."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        power, inverse = _power_tables(int(ends[j - 1] - lo) + 1)
        part = raw[lo : ends[j - 1]]
        part = _BYTE[_FOLD[part] if fold else part]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverse[starts[i:j] - lo]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words_of(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and each row's first index in them."""
    starts, ends, first = word_spans(raw, offs, kind)
    return hash_words(raw, starts, ends), first


_A = np.uint64(0xD6E8FEB86659FD93)


def joined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (also across rows; callers cut)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    x = hashes[:n].copy()
    for d in range(1, k):
        x *= _A
        x += hashes[d : d + n]
    return mix(x + np.uint64(k))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words give the whole sequence as one."""
    hashes, first = words_of(raw, offs, SPACED)
    runs = joined(hashes, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            row = np.sort(runs[lo : hi - k + 1])
            keep = np.empty(len(row), bool)
            keep[0] = True
            np.not_equal(row[1:], row[:-1], out=keep[1:])
            out.append(row[keep])
        else:
            out.append(joined(hashes[lo:hi], hi - lo) if hi > lo else runs[:0])
    return out
