"""Fill-in-middle transformation: an automaton scans chunks in parallel, composed transition functions place the cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import words

SEED = 42
#: Percent of documents that are transformed, and percent of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a lane: lanes are scanned side by side.
LANE = 256
#: Lanes that are scanned at once; bounds memory (a row of up to PART bytes comes whole).
LANES = 1 << 13
#: Bytes of a part. Longer documents are spread over tasks by parts of this size.
PART = 1 << 16
#: Kinds of document.
FORMS = ("plain", "psm", "spm")

# States: nothing read; in a blank; in a word; after "<" in it; after "<" and P, S or M; blank or word after a whole mark.
_START, _BLANK, _WORD, _OPEN, _LETTER, _BLANK_MARK, _WORD_MARK = range(7)
STATES = 7
# Classes of bytes: blank, "<", one of P S M, ">", any other; and none, where a lane has ended.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("<")], _CLASS[ord(">")], _CLASS[[*b"PSM"]] = 1, 3, 2
_NONE, _CLASSES = 5, 6
_NEXT = np.array(
    [
        [_BLANK, _OPEN, _WORD, _WORD, _WORD, _START],
        [_BLANK, _OPEN, _WORD, _WORD, _WORD, _BLANK],
        [_BLANK, _OPEN, _WORD, _WORD, _WORD, _WORD],
        [_BLANK, _OPEN, _LETTER, _WORD, _WORD, _OPEN],
        [_BLANK, _OPEN, _WORD, _WORD_MARK, _WORD, _LETTER],
        [_BLANK_MARK, _WORD_MARK, _WORD_MARK, _WORD_MARK, _WORD_MARK, _BLANK_MARK],
        [_BLANK_MARK, _WORD_MARK, _WORD_MARK, _WORD_MARK, _WORD_MARK, _WORD_MARK],
    ],
    np.uint8,
)
# A token begins with the first byte, and with every blank that follows a word.
_BEGINS = np.zeros((STATES, _CLASSES), np.uint8)
_BEGINS[_START, :_NONE] = 1
_BEGINS[[_WORD, _OPEN, _LETTER, _WORD_MARK], 0] = 1


class Scan:
    """Rows of bytes, scanned from every state at once.

    Each row is cut into lanes. A lane's function maps the state before it to
    the state after it and to the number of tokens that begin in it; functions
    compose associatively, so a doubling scan gives each lane's prefix.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        self.raw, self.offs = raw, offs
        sizes = np.diff(offs)
        self.many = np.maximum(1, -(-sizes // LANE))
        self.first = np.concatenate([[0], np.cumsum(self.many)])
        self.row = np.repeat(np.arange(len(sizes)), self.many)
        self.number = np.arange(self.first[-1]) - self.first[self.row]
        begin = offs[self.row] + self.number * LANE
        length = np.minimum(offs[self.row + 1] - begin, LANE)
        steps = np.arange(int(length.max(initial=0)))[:, None]
        where = np.minimum(begin + steps, max(0, len(raw) - 1))
        self.kind = np.where(steps < length, _CLASS[raw[where]] if len(raw) else np.uint8(_NONE), np.uint8(_NONE))
        end = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(begin), 1)
        count = np.zeros(end.shape, np.int64)
        begins, after = _BEGINS.ravel(), _NEXT.ravel()
        for kind in self.kind:
            code = end * np.uint8(_CLASSES) + kind
            count += begins[code]
            end = after[code]
        far = 1
        while far < self.many.max(initial=1):
            at = np.flatnonzero(self.number >= far)
            entry = end[:, at - far]
            counted = count[:, at - far] + np.take_along_axis(count[:, at], entry, 0)
            end[:, at] = np.take_along_axis(end[:, at], entry, 0)
            count[:, at] = counted
            far *= 2
        self.end, self.count = end, count

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the state after it and the tokens that begin in it, by the state before it."""
        last = self.first[1:] - 1
        return self.end[:, last].T, self.count[:, last].T

    def places(self, rows: np.ndarray, entry: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Byte in its row at which the ``nth`` token that begins there (from 0) begins; the row is entered in state ``entry``."""
        if not len(rows):
            return np.zeros(0, np.int64)
        out = np.empty(len(rows), np.int64)
        for state in np.unique(entry):
            own = np.flatnonzero(entry == state)
            total = self.count[state, self.first[1:] - 1]
            base = np.concatenate([[0], np.cumsum(total)[:-1]])
            lane = np.searchsorted(base[self.row] + self.count[state], base[rows[own]] + nth[own], "right")
            inner = self.number[lane] > 0
            now = np.where(inner, self.end[state, lane - 1], state).astype(np.uint8)
            before = np.where(inner, self.count[state, lane - 1], 0)
            seen = np.empty((len(self.kind), len(lane)), np.int64)
            for k, kind in enumerate(self.kind[:, lane]):
                code = now * np.uint8(_CLASSES) + kind
                seen[k] = _BEGINS.ravel()[code]
                now = _NEXT.ravel()[code]
            np.cumsum(seen, axis=0, out=seen)
            out[own] = self.number[lane] * LANE + np.argmax(seen > nth[own] - before, axis=0)
        return out


def scans(values: pa.Array) -> Iterator[tuple[int, int, Scan]]:
    """Rows of binary or string values, a bounded number of lanes at once: first row, end row, scan."""
    # parts are cut anywhere in the UTF-8 bytes, so the bytes aren't looked at as text
    for lo, hi, raw, offs in words.chunks(values.cast(pa.large_binary()).view(pa.large_string()), LANE * LANES):
        lanes = np.cumsum(np.maximum(1, -(-np.diff(offs) // LANE)))
        a = 0
        while a < hi - lo:
            b = max(a + 1, int(np.searchsorted(lanes, (lanes[a - 1] if a else 0) + LANES, "right")))
            yield lo + a, lo + b, Scan(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b


def characters(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all (one entry more than bytes)."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


@dataclass(frozen=True)
class Choice:
    """Whether a document is transformed, and how: percents, and the seed of its numbers."""

    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST
    seed: int = SEED

    def numbers(self, doc_id: Column) -> list[Column]:
        """h1 to h4 of a document: groups of its id's digest; a null id counts as no digits."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
        return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]

    def form(self, tokens: np.ndarray, marked: np.ndarray, h3: np.ndarray, h4: np.ndarray) -> np.ndarray:
        """Index into FORMS; a document without tokens, or with a mark in its text, stays plain."""
        plain = (tokens == 0) | marked | (h3 % 100 >= self.rate)
        return np.where(plain, 0, np.where(h4 % 100 < self.suffix_first, 2, 1))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The text of a document in its form."""
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)) if form == "spm" else prefix + middle + suffix


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark is in the text, and none can come about across a seam, so they part the output."""
    piece = F.split(output.cast("string"), "<P>|<S>|<M>", -1)
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output.cast("string"))


def _given(docs: DataFrame, choice: Choice) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *choice.numbers(F.col("doc_id").cast("long")), body.alias("__body"))


def short_documents(docs: DataFrame, choice: Choice = Choice(), part: int = PART) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (UTF-8) of every document of up to ``part`` bytes."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for lo, hi, scan in scans(batch.column("__body")):
                h1, h2, h3, h4 = (batch.column(f"__h{k}").to_numpy()[lo:hi] for k in (1, 2, 3, 4))
                end, count = scan.functions()
                n = count[:, _START]
                form = choice.form(n, end[:, _START] >= _BLANK_MARK, h3, h4)
                at = np.zeros((2, hi - lo), np.int64)
                for k, unit in enumerate((np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1)))):
                    at[k] = np.where(unit == n, np.diff(scan.offs), 0)
                    inside = np.flatnonzero((form > 0) & (unit > 0) & (unit < n))
                    at[k, inside] = scan.places(inside, np.full(len(inside), _START), unit[inside])
                chars, raw = characters(scan.raw), scan.raw.tobytes()
                for k in range(hi - lo):
                    a, d = int(scan.offs[k]), int(scan.offs[k + 1])
                    if not form[k]:
                        out.append((int(n[k]), "plain", None, None, raw[a:d]))
                        continue
                    b, c = a + int(at[0, k]), a + int(at[1, k])
                    name = FORMS[form[k]]
                    out.append((int(n[k]), name, int(chars[b] - chars[a]), int(chars[c] - chars[b]), joined(name, raw[a:b], raw[b:c], raw[c:d])))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    small = _given(docs, choice).filter(F.octet_length("__body") <= part)
    return small.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


@dataclass
class LongDocuments:
    """Documents of more than a part, by the number of their row."""

    summary: DataFrame  # row, doc_id, n, form, prefix_chars, middle_chars
    output: DataFrame  # row, form, at, body: pieces of the output, in order of at


def long_documents(docs: DataFrame, choice: Choice = Choice(), part: int = PART) -> LongDocuments:
    """The transformation of documents of over ``part`` bytes, each spread over tasks.

    Every part gives its transition function. A document's functions (narrow,
    and no more than a value of 2 GiB has parts) are composed, which gives the
    state and the count each part is entered with, and so the parts with the
    cuts; those find the byte. Then each part knows what of it is prefix,
    middle and suffix, and where that stands in the output.
    """
    many = F.ceil(F.octet_length("__body") / part).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.substring(F.col("__body"), k * part + 1, F.lit(part)))
    numbered = _given(docs, choice).filter(F.octet_length("__body") > part).withColumn("row", F.monotonically_increasing_id())
    # written: the number of a row must not depend on another run
    parts = staged(numbered.select("row", "doc_id", *(f"__h{k}" for k in (1, 2, 3, 4)), F.posexplode(pieces).alias("part", "body")), "fim-parts")

    def functions(batches):
        for batch in batches:
            ends, counts, chars = [], [], []
            for _, _, scan in scans(batch.column("body")):
                end, count = scan.functions()
                ends += end.tolist()
                counts += count.tolist()
                chars += np.diff(characters(scan.raw)[scan.offs]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "ends", "counts"])

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        k = len(table)
        ends, counts = (np.array(table.column(c).to_pylist(), np.int64).reshape(k, STATES) for c in ("ends", "counts"))
        entry, before = np.empty(k + 1, np.int64), np.zeros(k + 1, np.int64)
        entry[0] = _START
        for i in range(k):
            entry[i + 1], before[i + 1] = ends[i, entry[i]], before[i] + counts[i, entry[i]]
        n = before[-1:]
        h1, h2, h3, h4 = (table.column(f"__h{j}").to_numpy()[:1] for j in (1, 2, 3, 4))
        form = int(choice.form(n, entry[-1:] >= _BLANK_MARK, h3, h4)[0])
        cuts = sorted((int(h1[0] % (n[0] + 1)), int(h2[0] % (n[0] + 1))))
        same = lambda v, t: pa.array([v] * k, t)
        own = [table.column("row"), table.column("part"), table.column("doc_id"), same(int(n[0]), pa.int64()), same(FORMS[form], pa.string()), pa.array(entry[:-1], pa.int64())]
        # a cut before this part is at its begin (-1), one after it at its end (null), else at its nth token
        for cut in cuts:
            local = [None if cut >= b and not (cut == 0) else -1 if cut < a or cut == 0 else cut - a for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            own.append(pa.array(local, pa.int64()))
        return pa.table(own, names=["row", "part", "doc_id", "n", "form", "entry", "cut1", "cut2"])

    narrow = parts.select("row", "doc_id", *(f"__h{k}" for k in (1, 2, 3, 4)), "part", "body").mapInArrow(functions, "row long, doc_id long, __h1 long, __h2 long, __h3 long, __h4 long, part int, ends array<int>, counts array<long>")
    plan = staged(narrow.groupBy("row").applyInArrow(composed, "row long, part int, doc_id long, n long, form string, entry long, cut1 long, cut2 long"), "fim-plan")

    def cut(batches):
        names = ["row", "doc_id", "n", "form", "at", "prefix_chars", "middle_chars", "body"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            given = {c: batch.column(c).to_pylist() for c in ("row", "doc_id", "n", "form", "part", "entry", "cut1", "cut2")}
            for lo, hi, scan in scans(batch.column("body")):
                at = np.zeros((2, hi - lo), np.int64)
                for j in (0, 1):
                    nth = given[f"cut{j + 1}"][lo:hi]
                    at[j] = [0 if x == -1 else size for x, size in zip(nth, np.diff(scan.offs).tolist(), strict=True)]
                    inside = np.array([i for i, x in enumerate(nth) if x is not None and x >= 0], np.int64)
                    at[j, inside] = scan.places(inside, np.array([given["entry"][lo + i] for i in inside], np.int64), np.array([nth[i] for i in inside], np.int64))
                chars, raw = characters(scan.raw), scan.raw.tobytes()
                for i in range(hi - lo):
                    row, doc_id, n, form, number = (given[c][lo + i] for c in ("row", "doc_id", "n", "form", "part"))
                    a, d = int(scan.offs[i]), int(scan.offs[i + 1])
                    b, c = (a, d) if form == "plain" else (a + int(at[0, i]), a + int(at[1, i]))
                    order = {"psm": (1, 5, 3), "spm": (3, 5, 1), "plain": (1, 1, 1)}[form]
                    for slot, x, y, is_prefix, is_middle in ((order[0], a, b, 1, 0), (order[1], b, c, 0, 1), (order[2], c, d, 0, 0)):
                        if y > x:
                            size = int(chars[y] - chars[x])
                            out.append((row, doc_id, n, form, (slot << 32) + number, size * is_prefix, size * is_middle, raw[x:y]))
                    if form != "plain" and number == 0:
                        marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
                        out += [(row, doc_id, n, form, (2 * s) << 32, 0, 0, mark) for s, mark in enumerate(marks)]
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    placed = parts.select("row", "part", "body").join(plan, ["row", "part"]).select("row", "doc_id", "n", "form", "part", "entry", "cut1", "cut2", "body")
    output = staged(placed.mapInArrow(cut, "row long, doc_id long, n long, form string, at long, prefix_chars long, middle_chars long, body binary"), "fim-output")
    chars = [F.when(F.col("form") != "plain", F.sum(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return LongDocuments(output.groupBy("row", "doc_id", "n", "form").agg(*chars), output.select("row", "form", "at", "body"))


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces of a row side by side in one task, in order: read as a stream, never held together."""
    return pieces.repartition("row").sortWithinPartitions("row", "at")


def digests(pieces: DataFrame, name: str) -> DataFrame:
    """row and the SHA-256 of its pieces (row, at, body), read one after the other."""

    def run(batches):
        row, now = None, None
        for batch in batches:
            out = []
            for r, body in zip(batch.column("row").to_pylist(), batch.column("body"), strict=True):
                if r != row:
                    if now is not None:
                        out.append((row, now.hexdigest()))
                    row, now = r, hashlib.sha256()
                now.update(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["row", name])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([now.hexdigest()], pa.string())], ["row", name])

    return in_order(pieces.select("row", "at", "body")).mapInArrow(run, f"row long, {name} string")


def restored_pieces(output: DataFrame) -> DataFrame:
    """Pieces (row, at, body) of the texts that outputs (row, form, at, body) were made of, found by the marks in the outputs alone."""
    # what follows each mark: 0 prefix, 1 middle, 2 suffix
    order = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": ()}

    def run(batches):
        row, held, left, region, number = None, b"", [], 0, 0

        def cut(more: bytes, over: bool) -> list[tuple]:
            """What is now known to belong to a region; the last two bytes may begin a mark, unless the row is over."""
            nonlocal held, region, number
            held, out = held + more, []
            while left:
                at = held.find(left[0][0])
                if at < 0:
                    break
                out.append((row, (region << 40) + number, held[:at]))
                held, region, number = held[at + 3 :], left.pop(0)[1], number + 1
            keep = 2 if left and not over else 0
            if len(held) > keep:
                out.append((row, (region << 40) + number, held[: len(held) - keep]))
                held, number = held[len(held) - keep :], number + 1
            return [x for x in out if x[2]]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["row", "at", "body"])

        for batch in batches:
            out = []
            for r, form, body in zip(batch.column("row").to_pylist(), batch.column("form").to_pylist(), batch.column("body"), strict=True):
                if r != row:
                    out += cut(b"", True) if row is not None else []
                    row, held, left, region, number = r, b"", list(order[form]), 0, 0
                out += cut(body.as_py(), False)
            yield table(out)
        if row is not None:
            yield table(cut(b"", True))

    return in_order(output).select("row", "form", "body").mapInArrow(run, "row long, at long, body binary")


def transformed(docs: DataFrame, choice: Choice = Choice(), part: int = PART) -> DataFrame:
    """The contract's rows: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document.

    Texts of up to ``part`` bytes are transformed in the row; longer ones are
    spread over tasks, with the same results. Null text is empty, and an empty
    text plain with no tokens; a null doc_id has the numbers of an id without
    digits. Rows with equal or null ids are transformed each on its own; an
    empty table gives an empty result; other columns are left out, whatever
    their names.
    """
    short = short_documents(docs, choice, part).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    long = long_documents(docs, choice, part)
    own = long.summary.join(digests(long.output, "output_sha256"), "row").join(digests(restored_pieces(long.output), "restored_sha256"), "row")
    return short.unionByName(own.select(*short.columns))


#: DuckDB SQL for ``transformed`` over ``documents`` with ids.
TRANSFORMED_SQL = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS token, sha256('{SEED}:' || doc_id) AS digest FROM documents
), numbered AS (
  SELECT *, len(token) AS n, {", ".join(f"CAST('0x' || substr(digest, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM doc
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM numbered
), cut AS (
  SELECT *, array_to_string(token[1:a], '') AS p, array_to_string(token[a + 1:b], '') AS m, array_to_string(token[b + 1:n], '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE body END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM cut
"""
