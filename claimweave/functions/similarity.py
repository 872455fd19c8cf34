"""Sequence similarity that Spark has no function for, over Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, 0 to 1; null counts as empty, and two empty texts are equal."""
    out, known = [], {}
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        if (x, y) not in known:
            known[x, y] = 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
        out.append(known[x, y])
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.StringType())
def compatible_form(a: pd.Series) -> pd.Series:
    """Unicode compatibility form (NFKC); null stays null."""
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.DoubleType())
def phrase_ratio(phrase: pd.Series, text: pd.Series) -> pd.Series:
    """How well a phrase is found in a text: 1 if it's contained, else the best ratio over windows of as many words."""
    out = []
    for p, t in zip(phrase.fillna(""), text.fillna(""), strict=True):
        out.append(1.0 if p and p in t else _best_window(p, t))
    return pd.Series(out, dtype=float)


def _best_window(p: str, t: str) -> float:
    """The best ratio over windows of as many words: those with most letters in common first, until no other can be better.

    Matching blocks are a common subsequence, so a window whose longest one isn't long enough isn't compared.
    """
    words, n = t.split(), max(1, len(p.split()))
    if not words:
        return 0.0
    ends = np.cumsum([len(w) + 1 for w in words])
    n = min(n, len(words))
    lo, hi = np.concatenate([[0], ends])[: len(words) - n + 1], ends[n - 1 :] - 1
    codes, common = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.zeros(len(lo), dtype=np.int64)
    for c in set(p):
        seen = np.concatenate([[0], np.cumsum(codes == ord(c))])
        common += np.minimum(seen[hi] - seen[lo], p.count(c))
    bound = 2.0 * common / (hi - lo + len(p))
    matcher, best, whole = difflib.SequenceMatcher(None, "", p), 0.0, (1 << len(p)) - 1
    masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] <= best:
            break
        window, free = " ".join(words[k : k + n]), whole
        for c in window:
            if c in masks:
                x = free & masks[c]
                free = (free + x | free - x) & whole
        if 2.0 * (len(p) - free.bit_count()) / (len(window) + len(p)) > best:
            matcher.set_seq1(window)
            best = max(best, matcher.ratio())
    return best


def _edits(pattern: str, masks: dict[str, int], text: str) -> int:
    """Edit distance, a column of the table at once as the bits of two whole numbers (Myers, Hyyrö); ``masks`` keeps where letters stand in ``pattern``."""
    if not pattern:
        return len(text)
    if not masks:
        codes = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        masks[""] = (1 << len(pattern)) - 1
        for c in np.unique(codes):
            masks[chr(c)] = int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little")
    whole = up = masks[""]
    down = 0
    for c in text:
        x = masks.get(c, 0) | down
        same = (((up + (x & up)) ^ up) | x) & whole
        left = up & same
        right = ((down | (whole ^ (up | same))) << 1 | 1) & whole
        down = right & same
        up = (left << 1 & whole) | (whole ^ (right | same))
    return len(text) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts, for long ones: as Spark's, at a small part of its cost. Rows with one text ``b`` should stand together; null stays null."""
    out, last, masks = [], None, {}
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            last, masks = y, {}
        out.append(_edits(y, masks, x))
    return pd.Series(out, dtype="Int32")


def _forms(text: str, least: int, most: int, exchange: bool) -> list[str]:
    """What is left of a text after a few edits; see ``edited_forms``."""
    out, kept = [], {text}
    for cut in range(min(most, len(text)) + 1):
        free = most - cut - max(0, least - len(text) + cut)  # the other text loses so many letters at least
        if free < 0:
            break
        for k in kept:
            for n in range((min(free, len(k)) if exchange else 0) + 1):
                out += (f"{cut}{n}{','.join(map(str, at))}|{''.join(c for i, c in enumerate(k) if i not in at)}" for at in combinations(range(len(k)), n))
        kept = {k[:i] + k[i + 1 :] for k in kept for i in range(len(k))}
    return out


def edited_forms(text: Column, least: int, most: int, exchange: bool) -> Column:
    """All forms of a text (``most`` below ten), an array of: letters cut out, letters passed over, their places, what is left.

    Two texts of ``least`` letters or more are apart by at most ``most`` letters
    cut out of either or, with ``exchange``, also exchanged, exactly if two of
    their forms with as many edits in all are equal but for the first digit. Null has none.
    """
    return F.pandas_udf(lambda texts: texts.map(lambda x: [] if x is None else _forms(x, least, most, exchange)), T.ArrayType(T.StringType()))(text)
