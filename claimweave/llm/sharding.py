"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Shards that a corpus is cut into.
SHARDS = 8
#: Rows of one partition of the prefix sum, about.
ROWS_EACH = 200_000
#: Totals (one row for each partition) up to which their table is broadcast.
BROADCAST_TOTALS = 20_000


def sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, the columns in ``keep``, size (UTF-8 bytes of the text and 1; null text: 1), text_crc32 (null text: that of '') and the text's md5."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("__digest")
    )


def byte_shards(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = (), rows_each: int = ROWS_EACH) -> DataFrame:
    """doc_id, ``keep``, size, text_crc32, shard, slot of every row.

    Rows are in order of the text's md5, then doc_id (null first), so copies of
    a text stand together and only a cut that falls inside such a group splits
    it: at most ``shards - 1`` groups are. Ranges of that order are partitions
    (a group of any size goes over several); their byte and row totals, summed
    up, give each partition's offset, so every row's global prefix sum needs
    only its own partition. Shard ``s`` has the rows whose preceding bytes are
    at least ``s`` and below ``s + 1`` shares of the total: contiguous, and
    within one row of equal, however long a text is. Repeated rows, and rows
    with a null or shared id, are counted and placed each on its own; an empty
    table gives an empty result; a shard may be empty when there are fewer rows
    than shards. Columns not named in ``keep`` are left out; those named
    __digest, __tie, __row, __bytes or part must not be in it.
    """
    # the number tells equal rows apart, so that they too can go over several ranges
    narrow = staged(sizes(docs, list(keep)).withColumn("__tie", F.monotonically_increasing_id()), "sizes")
    rows = narrow.count()
    parts = max(1, -(-rows // rows_each))
    order = ["__digest", "doc_id", "__tie"]
    # written out: which range a row fell into must not depend on another run of the sampling
    ranged = staged(narrow.repartitionByRange(max(parts, 2), *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # a row for each partition
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total")
    )
    offsets = F.broadcast(offsets) if parts <= BROADCAST_TOTALS else offsets
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("__row", F.row_number().over(inside) - 1).withColumn("__bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, "part")
        .withColumn("__row", F.col("__row") + F.col("rows_before"))
        # decimal: the bytes of a corpus times the shards may pass 2^63
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(CAST(bytes_before + __bytes AS decimal(20,0)) * {int(shards)}) div total").cast("int")))
    )
    placed = staged(placed.select("doc_id", *keep, "size", "text_crc32", "shard", "__row"), "placed")
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("__row").alias("__start")))  # a row for each shard
    return placed.join(starts, "shard").select("doc_id", *keep, "size", "text_crc32", "shard", (F.col("__row") - F.col("__start")).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return byte_shards(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL for ``shard_table`` over ``documents`` with unique doc_id: CRC-32 by its polynomial, byte by byte, and prefix sums by a window.
SHARD_SQL = f"""
WITH RECURSIVE step AS (
  SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
doc AS (SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size FROM documents),
sized AS (
  SELECT doc_id, size, md5(body) AS digest, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM doc, crc
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), placed AS (SELECT doc_id, size, text_crc32, digest, CAST(least({SHARDS - 1}, before * {SHARDS} // total) AS INTEGER) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
