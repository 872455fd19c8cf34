"""Token totals kept up by deltas: signed inserts, deletes and revisions, committed once per batch.

A ledger is a folder of batches. Each batch is the signed sums of its changes
by source, language and tokenizer version; totals are the sums over committed
batches, so adding one reads nothing of what was counted before. A batch is
committed by Spark's success marker in the folder of its id: a batch that is
sent again is left as it is, one whose writing broke off is written anew.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, staged

GROUP = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_bytes")

#: Tokenizer versions that are counted by an expression.
COUNTERS = {"spaced-words-1": r"[^\x20\x09-\x0D]+", "alnum-words-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def expression_counters(patterns: dict[str, str] = COUNTERS) -> dict[str, Column]:
    return {v: F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(p)).cast("long") for v, p in patterns.items()}


def counted(docs: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """doc_id, source, lang, digest, n_bytes, tokenizer_version, n_tokens: a row for each document and version.

    A null source or language is the name '', a null text has no tokens and no
    digest. Texts are read once: the counts are written, and rows made of them.
    """
    text = F.col("text").cast("string")
    versions = F.array(*(F.struct(F.lit(v).alias("tokenizer_version"), c.alias("n_tokens")) for v, c in sorted(counters.items())))
    wide = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")),
            F.md5(text.cast("binary")).alias("digest"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), versions.alias("v"),
        ),
        "counted",
    )
    return wide.select("doc_id", "source", "lang", "digest", "n_bytes", F.explode("v").alias("v")).select("doc_id", "source", "lang", "digest", "n_bytes", "v.*")


def bpe_counted(docs: DataFrame, version: str, tokenizer_file: str) -> DataFrame:
    """The same rows with the counts of a public tokenizer's vocabulary file (tokenizers library, JSON), which all machines have at that path."""
    names = ["doc_id", "source", "lang", "digest", "n_bytes", "tokenizer_version", "n_tokens"]
    kinds = ("long", "string", "string", "string", "long", "string", "long")

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n: list[int] = []
            for k in range(0, len(texts), 256):
                n += [len(x) for x in tokenizer.encode_batch_fast([t or "" for t in texts[k : k + 256]], add_special_tokens=False)]
            kept = [batch.column(c) for c in ("doc_id", "source", "lang", "digest", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names)

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")),
        F.md5(text.cast("binary")).alias("digest"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"),
    )
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of ``counted`` as changes: 1 for inserts, -1 for deletes."""
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_bytes") * sign).alias("n_bytes"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """A revision takes the old counts out and puts the new ones in."""
    return signed(old, -1).unionByName(signed(new, 1))


def surplus_copies(rows: DataFrame) -> DataFrame:
    """Changes that take out all but one of the documents with equal texts, from rows of ``counted``.

    Copies are summed up by text, source and language before anything is joined,
    so a text with very many copies is a row for each of its sources.
    """
    of, version = ["digest", "source", "lang", "tokenizer_version"], ["digest", "tokenizer_version"]
    each = rows.filter("digest IS NOT NULL").groupBy(*of).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("t"), F.max("n_bytes").alias("b"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    )
    stays = each.groupBy(*version).agg(F.min(F.struct("first", "source", "lang")).alias("s"), F.sum("n").alias("all")).filter("all > 1")
    less = F.col("n") - ((F.col("source") == F.col("s.source")) & (F.col("lang") == F.col("s.lang"))).cast("long")
    gone = each.join(stays, version).select(*GROUP, less.alias("n"), "t", "b").filter("n > 0")
    return gone.select(*GROUP, (-F.col("n")).alias("n_docs"), (-F.col("n") * F.col("t")).alias("n_tokens"), (-F.col("n") * F.col("b")).alias("n_bytes"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def commit(ledger: str, batch_id: str, changes: DataFrame) -> bool:
    """Add a batch of changes to the ledger; false if that batch is in it already.

    One writer at a time for each batch id; a batch without changes is
    committed as well. The driver reads the names of batches, one each, and
    nothing of what is in them.
    """
    spark = changes.sparkSession
    path = f"{ledger}/batches/{batch_id}"
    if _exists(spark, f"{path}/_SUCCESS") or batch_id in _snapshot(spark, ledger)[1]:
        return False
    _sums(changes).write.mode("overwrite").parquet(path)
    return True


def _snapshot(spark: SparkSession, ledger: str) -> tuple[str | None, set[str]]:
    """The last complete snapshot and the batches in it."""
    for name in reversed(_children(spark, f"{ledger}/snapshots")):
        path = f"{ledger}/snapshots/{name}"
        if _exists(spark, f"{path}/members/_SUCCESS"):
            return f"{path}/totals", {r.batch_id for r in spark.read.parquet(f"{path}/members").collect()}
    return None, set()


def _pending(spark: SparkSession, ledger: str, done: set[str]) -> list[str]:
    return [b for b in _children(spark, f"{ledger}/batches") if b not in done and _exists(spark, f"{ledger}/batches/{b}/_SUCCESS")]


_SCHEMA = ", ".join(f"{c} string" for c in GROUP) + ", " + ", ".join(f"{c} long" for c in SUMS)


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """source, lang, tokenizer_version, n_docs, n_tokens, n_bytes over all committed batches; groups without documents are left out."""
    base, done = _snapshot(spark, ledger)
    paths = [*([base] if base else []), *(f"{ledger}/batches/{b}" for b in _pending(spark, ledger, done))]
    rows = spark.read.schema(_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], _SCHEMA)
    return _sums(rows).filter("n_docs <> 0")


def compact(spark: SparkSession, ledger: str) -> None:
    """Sum the committed batches up in a new snapshot. Its list of batches is written last and makes it valid."""
    _, done = _snapshot(spark, ledger)
    pending = _pending(spark, ledger, done)
    if not pending:
        return
    number = len(_children(spark, f"{ledger}/snapshots"))
    path = f"{ledger}/snapshots/{number:012d}"
    totals(spark, ledger).write.mode("overwrite").parquet(f"{path}/totals")
    spark.createDataFrame([(b,) for b in sorted(done | set(pending))], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/members")


def rollup(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Totals of ``docs`` after three batches: catalogue estimates, their revision by real counts, exact copies deleted.

    Documents come in with a quarter of their characters as token count, as a
    catalogue has it; all are then counted and revised; of equal texts all but
    one are deleted. The revision is sent twice, and counts once. The text that
    stays is that with the smallest doc_id (null last), then source, then
    language; rows equal in these too are still several, of which one stays.
    Null texts aren't copies of each other, and all stay. Texts are counted
    whole; an empty table gives an empty result; columns of ``docs`` other than
    doc_id, text, source and lang are left alone.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_folder(spark)}/claimweave/{uuid.uuid4().hex}/ledger"
    estimate = (F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) / 4).cast("long")
    real, first = counted(docs, expression_counters()), counted(docs, dict.fromkeys(COUNTERS, estimate))
    commit(ledger, "0001-estimates", signed(first, 1))
    for _ in range(2):
        commit(ledger, "0002-revision", revised(first, real))
    commit(ledger, "0003-copies", surplus_copies(real))
    compact(spark, ledger)
    return totals(spark, ledger)


#: DuckDB SQL for ``rollup`` over the table ``documents``.
ROLLUP_SQL = r"""
WITH kept AS (
  SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, coalesce(source, ''), coalesce(lang, '')) AS k FROM documents) WHERE text IS NULL OR k = 1
), counts AS (
  SELECT source, lang, 'spaced-words-1' AS tokenizer_version, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS t, strlen(body) AS b FROM kept
  UNION ALL
  SELECT source, lang, 'alnum-words-1', len(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), strlen(body) FROM kept
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens, CAST(sum(b) AS BIGINT) AS n_bytes FROM counts GROUP BY ALL
"""
