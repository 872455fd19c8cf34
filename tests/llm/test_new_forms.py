"""Packing, fill-in-middle and hard negatives."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from claimweave.llm import fim, hard_negatives, packing

BPE = "/opt/tokenizers/byte_bpe_50k.json"


def best_fit(items: list[int], size: int) -> int:
    """Sequences of best fit decreasing, piece by piece."""
    room: list[int] = []
    for x in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(size - x)
    return len(room)


@pytest.mark.parametrize("size", [1, 7, 16, 1024])
def test_plan_is_best_fit_decreasing(size):
    rng = random.Random(size)
    for _ in range(60):
        items = [rng.randint(1, size) if rng.random() < 0.5 else rng.choice([1, 1 + size // 3, 1 + size // 2, size]) for _ in range(rng.randint(1, 300))]
        items = [min(x, size) for x in items]
        runs, n = packing.planned(Counter(items), size)
        taken, placed = Counter(), {}
        for run in runs:
            assert run.first_rank == taken[run.length]
            taken[run.length] += run.slots
            for s in range(run.slots):
                placed.setdefault(run.first_sequence + s // run.each, []).append((run.offset + s % run.each * run.length, run.length))
        assert taken == Counter(items) and sorted(placed) == list(range(n)) and n == best_fit(items, size)
        for own in placed.values():
            own.sort()
            assert [at for at, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= size


def test_plan_of_any_number_of_pieces_is_small():
    runs, _ = packing.planned({k: 10**9 + 7919 * k * k % 10007 for k in range(1, 1025)})
    assert len(runs) <= 3 * 1024 * 10
    assert packing.planned({}) == ([], 0)
    with pytest.raises(ValueError):
        packing.planned({9: 1}, 8)


def test_ids_are_the_tokenizer_files_own(rows):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(BPE)
    own.encode_special_tokens = True
    ids = packing.encoder(packing.vocabulary(BPE))
    odd = ["", " ", "\n" * 70_000, "a" * 200_000, "<|endoftext|> x", "it's we'll ' s", "日本語 テスト　x​", "\x1c\x85\xa0 y", "a b" * 90_000]
    for text in odd + [t or "" for _, t, *_ in rows] + ["".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}. '{chr(c)}s" for c in range(lo, lo + 512)) for lo in range(0, 0xD800, 512)]:
        assert ids(text).tolist() == own.encode(text, add_special_tokens=False).ids
        assert "".join(packing.parts_of(text, 50)) == text


@pytest.mark.parametrize("size", [1024, 64])
def test_packed_documents(spark, documents, rows, size):
    ids = packing.encoder(packing.vocabulary(BPE))
    doubled = documents.union(documents.filter("doc_id < 130")).selectExpr("*", "1 AS part", "2 AS length", "3 AS rank")
    got = packing.packed(doubled, BPE, size, keep_ids=True)
    out = got.collect()
    of_doc, text = Counter(i for i, *_ in rows), {i: t or "" for i, t, *_ in rows}
    of_doc.update(i for i, *_ in rows if i < 130)
    pieces: dict = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
        assert r.length == len(r.ids) <= size and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, many in of_doc.items():
        whole = [*ids(text[i]).tolist(), packing.END]
        at = 0
        for k in range(-(-len(whole) // size)):
            assert len(pieces[i, k]) == many
            length = (len(whole) % size or size) if k == 0 else size
            assert all(r.start == at and r.ids == whole[at : at + length] for r in pieces[i, k])
            at += length
        assert (i, k + 1) not in pieces and at == len(whole)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[k][0] == sum(x for _, x in sorted(v)[:k]) for v in by.values() for k in range(len(v))) and len(by) == best_fit([r.length for r in out], size)
    full = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in full) == sum(r.length for r in out) and max(len(r.ids) for r in full) <= size and len(full) == len(by)


def test_packing_awkward_rows(spark, no_documents):
    assert packing.packed(no_documents, BPE).count() == 0
    docs = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, "x")], "doc_id long, text string")
    out = packing.packed(docs, BPE)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert sorted((r.length, r.offset) for r in out.collect()) == [(1, 2), (1, 3), (1, 4), (2, 0)]


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled_in(doc_id: int | None, text: str | None, rate: int = 50) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate else "spm" if h[3] % 100 < 80 else "psm"
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(output), sha(text)


def marked_rows() -> list[tuple]:
    rng = random.Random(11)
    tricky = ["<P", "<S", "<", ">", "P>", " ", "\n", "é", "x", "<P>", "<<S", "M>", "日本 "]
    return [(10_000 + k, "".join(rng.choice(tricky if k % 3 else tricky[:9]) for _ in range(rng.randint(0, 40)))) for k in range(200)]


@pytest.mark.parametrize("part", [1 << 16, 100, 7])
def test_fill_in_middle_equals_plain_version(spark, rows, part):
    """Whatever the size of the parts: short documents in their row, long ones over tasks."""
    given = [(i, t) for i, t, *_ in rows if part > 7 or i != 600] + marked_rows()
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS row", "2 AS form", "3 AS at")
    out = fim.transformed(docs, part=part)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    assert sorted(map(tuple, out.collect())) == sorted(filled_in(i, t) for i, t in given)
    assert {r[2] for r in out.collect()} == set(fim.FORMS)


def test_fill_in_middle_equals_sql(spark, documents):
    con = duckdb.connect()
    con.register("given", documents.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM given")
    assert sorted(map(tuple, fim.transformed(documents).collect())) == sorted(con.execute(fim.TRANSFORMED_SQL).fetchall())


def test_fill_in_middle_awkward_rows(spark, no_documents):
    assert fim.transformed(no_documents).count() == 0
    text = "some words " * 30
    given = [(None, text), (None, text), (None, None), (3, text), (3, text), (3, ""), (3, "  "), (4, "a")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    every = fim.Choice(rate=100)
    for part in (1 << 16, 50):
        assert sorted(map(repr, (tuple(r) for r in fim.transformed(docs, every, part).collect()))) == sorted(repr(filled_in(i, t, 100)) for i, t in given)


def test_lanes_compose(rows):
    """The functions of any split of a text compose to its own."""
    raw = np.frombuffer(("ab <P <S> x\n\n" * 50 + "é <" + " M> tail  ").encode(), np.uint8)
    whole = fim.Scan(raw, np.array([0, len(raw)]))
    end, count = (x[0] for x in whole.functions())
    for cut in range(0, len(raw), 17):
        two = fim.Scan(raw, np.array([0, cut, len(raw)]))
        e, c = two.functions()
        assert (e[1][e[0]] == end).all() and (c[0] + c[1][e[0]] == count).all()


def mined(rows: list[tuple]) -> list[tuple]:
    """All pairs, by plain Python integers."""
    part = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for k, i, label, v in part:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, q, other) for q, j, other, w in part if q != k)
        for score, positive, *_ in [x for x in scored if x[3] == label][:5]:
            wanted = [(j, -s) for s, j, _, other in scored if other != label and 80 * -score <= 100 * -s <= 100 * -score][:5]
            out += [(i, positive, rank, j, -score, s) for rank, (j, s) in enumerate(wanted, 1)]
    return out


def vectors(seed: int, n: int = 700, scale: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(int(i), (scale * rng.normal(0.3, 0.5, 6)).tolist(), int(rng.choice([1, 1, 1, 2, 3]))) for i in range(n)]
    for k in range(20, 60):
        rows[k] = (k, rows[0][1], rows[k][2])  # ties
    return rows


@pytest.mark.parametrize("scale", [1.0, 3000.0])
@pytest.mark.parametrize("anchor_bytes", [1 << 25, 200])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, anchor_bytes, scale):
    rows = vectors(5, 400 if anchor_bytes == 200 else 700, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    from pyspark.sql import functions as F

    out = hard_negatives.mined(df, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), anchor_bytes=anchor_bytes)
    assert sorted(map(tuple, out.collect())) == sorted(mined(rows)) and out.count()


def test_hard_negatives_equal_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    out = hard_negatives.hard_negatives(spark.read.parquet(f"{small_dir}/embeddings.parquet"))
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    got = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hard_negatives.HARD_NEGATIVES_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(got)


def test_hard_negatives_awkward_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(empty).count() == 0
    rows = vectors(9, 230)
    rows[5] = (5, None, 1)
    rows[6] = (6, [1.0, None, 0.0], 2)
    rows[7] = (7, [float("nan")] * 6, 2)
    rows[8] = (8, [float("inf")] * 6, 2)
    rows[9] = (9, [5.0] * 6, None)
    rows[10] = (None, [5.0] * 6, 1)
    rows[11] = (11, [9.0, 9.0], 2)  # shorter
    rows[12] = (12, [], 2)
    rows += [rows[100], rows[100], rows[33]]  # repeated, an anchor among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS row", "2 AS score", "3 AS anchor")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df.coalesce(1)).collect())) == sorted(mined(rows))
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(alone).count() == 0
