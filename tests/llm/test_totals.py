"""Shards, mixtures, token totals and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from claimweave.llm import decontaminate, mixing, sharding, token_rollup
from tests.llm import brute


def duck(spark_docs):
    """DuckDB with the same table."""
    con = duckdb.connect()
    con.register("given", spark_docs.select("doc_id", "text", "lang", "source").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM given")
    return con


@pytest.mark.parametrize("rows_each", [10, 1_000_000])
def test_shards_are_contiguous_and_balanced(documents, rows, rows_each):
    md5 = {i: hashlib.md5((t or "").encode()).hexdigest() for i, t, *_ in rows}
    out = sorted(sharding.byte_shards(documents, 8, rows_each=rows_each).collect(), key=lambda r: (md5[r.doc_id], r.doc_id))
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    total, below, slots = sum(size.values()), 0, Counter()
    for r in out:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((next(t for i, t, *_ in rows if i == r.doc_id) or "").encode())
        assert r.shard == min(7, below * 8 // total) and r.slot == slots[r.shard]
        below += size[r.doc_id]
        slots[r.shard] += 1
    assert len(out) == len(rows)


def test_shards_equal_sql_and_keep_copies_together(documents, rows):
    more = documents.union(documents.filter("doc_id BETWEEN 500 AND 520").withColumn("doc_id", F.col("doc_id") + 10_000))
    df = sharding.shard_table(more)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    out = df.collect()
    assert sorted(map(tuple, out)) == sorted(duck(more).sql(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({sharding.SHARD_SQL})").fetchall())
    of = {r.doc_id: r.shard for r in out}
    assert sum(of[k] != of[k + 10_000] for k in range(500, 521)) <= 7


def test_copies_that_hold_most_rows_go_over_shards(spark):
    """A text of most rows, without ids, is split where it must be; sizes stay equal."""
    docs = spark.range(4000).selectExpr("IF(id % 4 = 0, id, NULL) AS doc_id", "IF(id % 4 = 0, concat('t', id), 'the same text') AS text")
    out = sharding.byte_shards(docs, 8, rows_each=100).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(out) == 8 and max(r.b for r in out) - min(r.b for r in out) <= 30


def test_shards_of_awkward_rows(spark, no_documents):
    assert sharding.shard_table(no_documents).count() == 0
    rows = [(None, "a"), (None, "a"), (5, None), (5, None), (7, "é" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS size", "3 AS part", "'x' AS law")
    out = sharding.shard_table(docs).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 2, 2, 201]
    for s in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize(
    "mix",
    [
        mixing.Mix(), mixing.Mix(max_epochs=1, budget_percent=70), mixing.Mix(domains={"crawl": 1, "curated": 0, "reference": 30}, max_epochs=3),
        mixing.Mix(domains={}, languages={"": 9, "en": 1}, sources={"src0": 1, "src1": 50}, max_epochs=2, budget_percent=50),
    ],
)
def test_mixture_equals_sql(documents, mix):
    out = sorted(map(tuple, mixing.mixture(documents, mix).select("doc_id", "domain", "language", "source", "tokens", "copies", "leaf_tokens", "leaf_budget").collect()))
    want = duck(documents).sql(f"SELECT doc_id, domain, language, source, tokens, copies, leaf_tokens, leaf_budget FROM ({mixing.mixture_sql(mix)}) ORDER BY doc_id").fetchall()
    assert out == want
    assert mixing.mixed(documents, mix).count() == sum(r[5] for r in out)
    assert mixing.mixed(documents, mix).columns == documents.columns


def test_shortages_go_to_siblings_first(spark):
    """A leaf that runs out is made up within its language, and the domain keeps its share."""
    rows = [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d1", "fr", "c", 1000), ("d2", "en", "d", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, language string, source string, tokens long")
    mix = mixing.Mix(domains={"d1": 1, "d2": 1}, languages={"en": 1, "fr": 1}, sources={"a": 1, "b": 1}, budget_percent=26, max_epochs=1)
    budget = {r.source: r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    given = 3010 * 26 // 100
    assert budget == {"a": 10, "b": given // 4 - 10, "c": given // 4, "d": given // 2}


def test_mixture_of_awkward_rows(spark, no_documents):
    assert mixing.mixture(no_documents, mixing.Mix()).count() == 0
    rows = [(None, "a b", None, None), (1, None, "en", "src0"), (1, None, "en", "src0"), (2, "x y z", "en", "src0")]
    docs = spark.createDataFrame(rows, no_documents.schema).selectExpr("*", "1 AS domain", "2 AS tokens", "3 AS epochs", "4 AS cut_key")
    out = mixing.mixture(docs, mixing.Mix(max_epochs=2))
    assert out.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] >= 4
    assert mixing.mixed(docs, mixing.Mix(max_epochs=2)).columns == docs.columns


def test_rows_without_ids_and_equal_rows_are_taken_one_by_one(spark):
    """Leaves whose ids are all null, or one id, or whose rows are all equal, keep to the budget within a row."""
    rows = [(None, f"a b {k}", "en", "src0") for k in range(200)] + [(7, f"a b {k}", "de", "src1") for k in range(200)] + [(9, "a b c", "fr", "src2")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).selectExpr("*", "1 AS part", "2 AS digest")
    for percent, epochs in ((30, 1), (130, 2), (100, 1)):
        mix = mixing.Mix(domains={"crawl": 1, "curated": 2}, languages={}, budget_percent=percent, max_epochs=epochs)
        out = mixing.mixture(docs, mix).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.max("leaf_budget").alias("budget"), F.max("copies").alias("most")).collect()
        assert len(out) == 3 and all(0 <= r.n - r.budget < 3 and r.most <= epochs for r in out)
        assert mixing.mixed(docs, mix).count() == sum(r.n for r in out) // 3 and mixing.mixed(docs, mix).columns == docs.columns


def test_mixture_of_very_long_texts(spark):
    rows = [(k, "word " * 400_000, "en", "src0") for k in range(3)] + [(9, "word", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixture(docs, mixing.Mix(budget_percent=50, max_epochs=1)).collect()
    assert 600_000 <= sum(r.tokens for r in out) < 1_000_001 + 400_000


def test_rollup_equals_sql(documents):
    out = sorted(map(tuple, token_rollup.rollup(documents).select("source", "lang", "tokenizer_version", "n_docs", "n_tokens", "n_bytes").collect()))
    assert out == duck(documents).sql(f"SELECT source, lang, tokenizer_version, n_docs, n_tokens, n_bytes FROM ({token_rollup.ROLLUP_SQL}) ORDER BY ALL").fetchall()


def test_one_of_equal_texts_stays(spark):
    """Whatever their ids: null, repeated, in several sources; the query and its SQL agree."""
    rows = [(None, "a b", "en", "s"), (None, "a b", "en", "s"), (None, "a b", "de", "s"), (3, "x", "en", "s"), (3, "x", "en", "s"), (3, "x", "en", "r"), (5, None, None, None), (5, None, None, None), (6, "y z", None, "s"), (7, "y z", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted(map(tuple, token_rollup.rollup(docs.selectExpr("*", "1 AS n_tokens", "2 AS digest")).select("source", "lang", "tokenizer_version", "n_docs", "n_tokens", "n_bytes").collect()))
    assert out == duck(docs).sql(f"SELECT source, lang, tokenizer_version, n_docs, n_tokens, n_bytes FROM ({token_rollup.ROLLUP_SQL}) ORDER BY ALL").fetchall()
    assert sum(r[3] for r in out) == 2 * 5


def test_batches_count_once(spark, documents, no_documents, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    assert token_rollup.totals(spark, ledger).count() == 0
    rows = token_rollup.counted(documents, token_rollup.expression_counters())
    assert token_rollup.commit(ledger, "b1", token_rollup.signed(rows, 1)) and not token_rollup.commit(ledger, "b1", token_rollup.signed(rows, 1))
    before = sorted(map(tuple, token_rollup.totals(spark, ledger).collect()))
    assert token_rollup.commit(ledger, "b2", token_rollup.signed(rows.filter("doc_id < 200"), -1))
    assert token_rollup.commit(ledger, "b3", token_rollup.signed(rows.filter("doc_id < 200"), 1))
    token_rollup.compact(spark, ledger)
    assert not token_rollup.commit(ledger, "b2", token_rollup.signed(rows, -1))
    assert token_rollup.commit(ledger, "b4", token_rollup.signed(token_rollup.counted(no_documents, token_rollup.expression_counters()), 1))
    token_rollup.compact(spark, ledger)
    assert sorted(map(tuple, token_rollup.totals(spark, ledger).collect())) == before
    # a batch whose writing broke off doesn't count, and can be written anew
    (tmp_path / "ledger/batches/b5").mkdir()
    (tmp_path / "ledger/batches/b5/part-0.parquet").write_bytes(b"broken")
    assert sorted(map(tuple, token_rollup.totals(spark, ledger).collect())) == before
    assert token_rollup.commit(ledger, "b5", token_rollup.signed(rows, -1))
    assert token_rollup.totals(spark, ledger).count() == 0


def test_public_tokenizer_counts(spark, documents, rows):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in token_rollup.bpe_counted(documents, "bpe-50k", path).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}


def test_pipeline_stage_by_stage(spark, small_dir):
    """Every stage against brute force on its own input; clean documents stay up to the mixture."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, small_dir)
    assert known.columns == docs.columns and known.count() >= 0.98 * docs.count()
    single = stage["near_copies"](spark, known, small_dir)
    want = {i for i, (_, c) in brute.groups([(r.doc_id, r.text) for r in known.collect()]).items() if c == i}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want
    clean = stage["benchmark"](spark, single, small_dir)
    bad = {i for i, x in brute.contaminated([(r.doc_id, r.text) for r in single.collect()], items).items() if x[4]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want - bad
    mixed = stage["mixture"](spark, clean, small_dir)
    sql = duck(clean).sql(f"SELECT doc_id FROM ({mixing.mixture_sql(corpus_pipeline.MIX)})").fetchall()
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(x[0] for x in sql)
    shards = stage["shards"](spark, mixed, small_dir).collect()
    assert {r.doc_id for r in shards} == {x[0] for x in sql} and {r.shard for r in shards} == set(range(8))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small_dir).collect()) == sorted(r.doc_id for r in shards)


def test_pipeline_stages_with_awkward_rows(spark, small_dir, tmp_path):
    """Null and repeated ids, equal rows, shared ids of different texts, clashing columns, and an empty table."""
    import corpus_pipeline

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").filter("length(text) > 600 AND lang = 'en'").limit(4).collect()}
    a, b, c, d = text.values()
    passage = spark.read.parquet(f"{small_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(None, a), (None, a), (7, a), (7, b), (7, b), (None, c), (8, d + " " + passage), (8, passage), (None, None), (9, ""), (9, "12 34")]
    odd = spark.createDataFrame([(i, t, "en", "src1", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_hit int, component_id int")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, odd.unionByName(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang", "source"), allowMissingColumns=True), small_dir)
    assert known.filter("n_hit = 1 AND text IS NULL OR text IN ('', '12 34')").count() == 0
    single = stage["near_copies"](spark, odd, small_dir)
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert single.columns == odd.columns and sorted(kept, key=repr) == sorted([(7, a), (7, b), (None, c), (8, d + " " + passage), (8, passage), (None, None), (9, ""), (9, "12 34")], key=repr)
    clean = [(r.doc_id, r.text) for r in stage["benchmark"](spark, odd, small_dir).collect()]
    assert (8, passage) not in clean and clean.count((None, a)) == 2 and clean.count((7, b)) == 2 and (None, None) in clean
    none = odd.limit(0)
    for name, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, none, small_dir).count() == 0, name


def test_one_pass_decontamination_reads_items_in_blocks(spark):
    items = spark.createDataFrame([(k, f"w{k} x{k} y{k}") for k in range(9)], "item_id long, text string")
    assert len(list(decontaminate.item_blocks(items, block_words=7))) == 5
