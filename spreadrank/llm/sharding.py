"""Sharding by global byte-size prefix sums.

Documents stand in doc_id order as one line of bytes. Each key range sums its
bytes, the range totals give every range its offset, and a document goes to
the shard in whose equal share of the line its middle byte falls. Shards are
contiguous in doc_id order; their sizes differ from the target by less than
one document. All of it is built-in DataFrame functions.

Nulls: a null text has no bytes (size 16, crc 0); a null doc_id comes first.
An empty table gives no rows. Repeated rows are placed one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import docs_only, table
from .ranking import with_prefix

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs_only(docs).select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = with_prefix(rows, ["doc_id", "text_crc32", "size"], {"before": F.col("size"), "place": F.lit(1)})
    # one total row; a plain cross product with it would be a nested loop over all rows otherwise
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = F.expr(f"least({shards - 1}, ((2 * before + size) * {shards}) div {2 * total})")
    placed = placed.withColumn("shard", middle.cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("_first")).withColumnRenamed("shard", "_s")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


SQL = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, n::BIGINT)) AS t
), d AS (
  SELECT doc_id, coalesce(text, '') AS x, hex(coalesce(text, '')) AS h FROM documents
), s AS (
  SELECT doc_id, CAST(strlen(x) + {ROW_BYTES} AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM d, bits
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS place, sum(size) OVER () AS total
  FROM s
), q AS (
  SELECT *, CAST(least({SHARDS - 1}, ((2 * before + size) * {SHARDS}) // (2 * total)) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q
"""
