"""Near copies and benchmark passages against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from claimweave.llm import decontaminate, ngram_join
from tests.llm import brute


def got_groups(docs, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"frequent_from": 2}, {"frequent_from": 3, "short": 3, "block": 4}, {"short": 2, "rounds": 0, "block": 8}, {"short": 2, "rounds": 1, "block": 5}])
def test_groups_equal_brute_force(documents, rows, how):
    """Whichever shingles are frequent and lists are long, the groups are those of all links."""
    assert got_groups(documents, **how) == brute.groups([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("how", [{}, {"frequent_from": 2, "short": 3, "block": 4}])
def test_links_are_counted_like_all_pairs(documents, rows, how, monkeypatch):
    """Every set's number of other sets it links to, also in families cut into several tiles."""
    monkeypatch.setattr(ngram_join.link_counts, "__defaults__", (ngram_join.THRESHOLD, 9000 if how else ngram_join.TILE_BYTES))
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    kinds = {s for s in sets.values() if s}
    want = {s: sum(100 * len(s & t) >= 85 * len(s | t) for t in kinds) - 1 for s in kinds}
    out = ngram_join.similar_groups(documents, **how).collect()
    assert {r.doc_id: r.n_links for r in out} == {i: want.get(s, 0) for i, s in sets.items()}
    assert max(want.values()) > 20


def test_sets_are_found_by_a_filter_of_their_number(spark, documents, rows):
    """In one pass or in several: all wanted sets come, and hardly any others."""
    assert ngram_join._bloom_plan(0, 1 << 29) == (1 << 20, 1) and ngram_join._bloom_plan(3_000_000, 1 << 29) == (1 << 27, 1)
    assert ngram_join._bloom_plan(10**9, 1 << 29) == (1 << 29, 60)
    docs = documents.select("doc_id", "text")
    every = {}
    for _, text, *_ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x = ngram_join.words.shingle_sets(raw, np.array([0, len(raw)]), 4)[0]
        if len(x):
            every[ngram_join.set_id(x)] = x.tobytes()
    names = sorted(every)[::3]
    wanted = spark.createDataFrame([(n,) for n in names], "set_id long")
    for most in (1 << 29, 1 << 10, 1 << 20):
        found = {r.set_id: bytes(r.shingles) for r in ngram_join.sets_of(docs, wanted, 4, most).collect()}
        assert set(names) <= set(found) and all(every[n] == x for n, x in found.items()) and len(found) <= len(names) + len(every) // 20


def test_groups_equal_sql(spark, small_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    df = ngram_join.similar_groups(spark.read.parquet(f"{small_dir}/documents.parquet"))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ngram_join.GROUPS_SQL})").fetchall())


def test_a_row_goes_only_for_its_own_text(spark):
    """Null and repeated ids: a text that nobody else has stays, of equal rows one does."""
    same, own = "one text that several rows have in common here", "a text that nobody else has"
    rows = [(None, same, 1), (None, same, 2), (3, same, 3), (3, same, 4), (7, same, 5), (7, own, 6), (None, None, 7), (None, None, 8), (9, "", 9), (None, "only rows without ids", 10), (None, "only rows without ids", 11)]
    kept = ngram_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert {r.row for r in kept} - {3, 4, 10, 11} == {6, 7, 8, 9} and len(kept) == 6 and len({r.row for r in kept} & {3, 4}) == 1


def test_rounds_of_nearest_partners(documents, rows, monkeypatch):
    """Also where members have more partners than are verified at once."""
    monkeypatch.setattr(ngram_join, "NEAREST", 1)
    for rounds in (2, 8):
        assert got_groups(documents, short=2, rounds=rounds, block=6) == brute.groups([(r[0], r[1]) for r in rows])


def test_real_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert got_groups(docs) == brute.groups([(r.doc_id, r.text) for r in docs.collect()])


def test_one_stays_of_each_group(documents, rows):
    want = {i for i, (_, c) in brute.groups([(r[0], r[1]) for r in rows]).items() if c == i}
    kept = ngram_join.one_of_each_group(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == want


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(7, "a b c d e", "x"), (7, "a b c d e", "x"), (None, "a b c d e", "y"), (9, "q r s t u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id string").selectExpr("*", "1 AS component_id", "2 AS n_shingles", "'b' AS bitmap")
    out = ngram_join.similar_groups(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.n_copies) for r in out) == [(-1, 7, 3), (7, 7, 3), (7, 7, 3), (9, 9, 1)]


def test_empty_tables(spark, no_documents):
    assert ngram_join.similar_groups(no_documents).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_documents, benchmark).count() == 0


def test_signatures_of_linked_sets_meet():
    """Any two sets over the threshold share a key, whatever is frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 120))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = rng.random(len(x)) > 0.07
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both, whole = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * both < 85 * whole or len(x) < 2 or len(y) < 2:
            continue
        share = rng.random()
        hot = {int(v) for v in np.union1d(x, y) if rng.random() < share}
        keys = [set(ngram_join.signatures(s, np.array([int(v) in hot for v in s], bool))[0].tolist()) for s in (x, y)]
        assert keys[0] & keys[1]


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05], rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64)]))
        both, whole = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        p, q = (np.frombuffer(ngram_join.parity_bitmap(s), "<u8") for s in (x, y))
        size = min(len(p), len(q))
        differ = int(np.bitwise_count(ngram_join._folded(p, size) ^ ngram_join._folded(q, size)).sum())
        if len(y) and 100 * both >= 85 * whole:
            assert ngram_join._may_link(len(x), len(y), differ, 85)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    text = {r[0]: r[1] for r in rows}
    words = text[405].split()
    items = [(1, " ".join(words[10:40])), (2, " ".join(words[20:33]).upper()), (3, None), (4, ""), (5, "w1 w2"), (6, " ".join(words[70:75])), (7, "never seen words " * 9)]
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination_equals_brute_force(documents, benchmark, rows):
    want = brute.contaminated([(r[0], r[1]) for r in rows], [(r.item_id, r.text) for r in benchmark.collect()])
    for how in ({}, {"block_words": 20}):  # one block of items, and many
        out = decontaminate.contamination(documents, benchmark, **how).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == want
        kept = decontaminate.decontaminated(documents, benchmark, **how)
        assert kept.columns == documents.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]}


@pytest.mark.parametrize("how", [{}, {"block_words": 20}])
def test_rows_are_judged_each_on_its_own(spark, how):
    """Null and repeated ids, repeated rows and items without an id; in one block of items, and in many."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(13))) for k in (1, 2, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hit, clean = [t for _, t in items], [" ".join(f"{c}{j}" for j in range(13)) for c in "xy"]
    rows = [(None, hit[0]), (None, clean[0]), (7, hit[1]), (7, clean[0]), (8, hit[0]), (8, hit[0]), (9, clean[1]), (9, clean[1]), (10, hit[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.contamination(docs, benchmark, **how).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out) == sorted((i or 0, 13, 13 * (t in hit), int(t in hit), t in hit) for i, t in rows)
    kept = decontaminate.decontaminated(docs, benchmark, **how).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows if t not in hit)


def test_contamination_equals_sql(spark, small_dir):
    import duckdb

    con = duckdb.connect()
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    df = decontaminate.contamination(docs, items)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({decontaminate.CONTAMINATION_SQL})").fetchall())


@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("block_words", [40, 1_000_000])
def test_longest_matches_of_suffixes_equal_brute_force(spark, least, block_words):
    """Length, places and first place of every test suffix, over several shards and blocks, short and repeated texts included."""
    import random

    rng = random.Random(3)
    text = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    docs = [(k % 9 or None, text(rng.randrange(0, 60), 5)) for k in range(30)] + [(50, None), (51, "")]
    items = [(str(k), text(rng.choice((1, 4, 20)), 7)) for k in range(8)] + [("none", None)]
    want = {}
    for item, t in items:
        w = (t or "").split()
        for i in range(len(w)):
            for n in range(len(w) - i, least - 1, -1):
                at = [(d is None, d or 0, j) for d, x in docs for j in range(len((x or "").split()) - n + 1) if (x or "").split()[j : j + n] == w[i : i + n]]
                if at:
                    no_id, d, j = min(at)
                    want[item, i] = (n, len(at), None if no_id else d, j)
                    break
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = decontaminate.suffix_matches(rows, spark.createDataFrame(items, "item_id string, text string"), least, block_words).collect()
    assert {(r.item_id, r.item_word): (r.length, r.n_places, r.doc_id, r.doc_word) for r in out} == want


def test_repeated_words_take_memory_in_proportion(spark):
    """A long text of one word against a long item of it: ranges are marked, places aren't paired."""
    import tracemalloc

    raw = np.frombuffer(b"x " * 20_000, np.uint8)
    block = decontaminate._block(["i"], [decontaminate.words.words_of(raw[:4000], np.array([0, 4000]), decontaminate.words.ALNUM)[0]], 13)
    tracemalloc.start()
    _, n_hit, _, names = decontaminate._scan(block, raw, np.array([0, len(raw)]))
    assert n_hit.tolist() == [20_000] and names == [["i"]] and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_a_filter_that_lets_all_through_changes_nothing(spark, documents, benchmark, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOOM_BITS", 64)
    want = brute.contaminated([(r[0], r[1]) for r in rows], [(r.item_id, r.text) for r in benchmark.collect()])
    out = decontaminate.contamination(documents, benchmark, block_words=20).collect()
    assert {r.doc_id: r.n_hit for r in out} == {i: x[1] for i, x in want.items()}
    assert {r.doc_id for r in decontaminate.decontaminated(documents, benchmark, block_words=20).collect()} == {i for i, x in want.items() if not x[4]}


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    tokens = np.append(rng.integers(1, 4, 200), 0)
    array = decontaminate.suffix_array(tokens, np.arange(200), 8)
    key = lambda i: tuple(tokens[i : i + 8].tolist())
    assert [key(i) for i in array] == sorted(key(i) for i in range(200))
    queries = np.append(rng.integers(1, 4, 30), 0)
    at, most = np.arange(25), np.full(25, 5)
    length, lo, hi = decontaminate.search(tokens, array, queries, at, most)
    text = tokens.tolist()
    for q, n, x, y in zip(at, length, lo, hi, strict=True):
        want = [i for i in range(200) if text[i : i + n] == queries[q : q + n].tolist()]
        assert sorted(array[x:y].tolist()) == want
        assert n == 5 or not any(text[i : i + n + 1] == queries[q : q + n + 1].tolist() for i in range(200))
