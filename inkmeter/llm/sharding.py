"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned on a total order, each partition contributes one (rows, bytes) total, and
the running sums of those totals give every partition its global offset. A row belongs to the shard
whose equal byte target its first byte falls into. Only built-in DataFrame functions are used.

The order is (MD5 of the text, doc_id): equal texts lie next to each other, so a group of copies stays
together unless a cut falls inside it, and a group larger than a shard is still cut evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, load, stage, text_or_empty

LAW = "bytes"


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near-equal size.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the UTF-8 length
    plus ``overhead`` (null text: the overhead alone, CRC 0). Shard sizes differ from the equal target
    by less than one row. Null ids sort first; repeated rows keep their own slots, ties between them
    being interchangeable; an empty table gives an empty result. Other columns are ignored.
    """
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("order_key"),
    )
    spread = stage(
        sized.repartitionByRange("order_key", "doc_id").withColumn("part", F.spark_partition_id()),
        "shard-order",
    )
    within = W.partitionBy("part").orderBy("order_key", "doc_id", "size")
    # one row per range partition: bounded by the partition count, whatever the input
    totals = spread.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base"),
        F.sum("part_bytes").over(W.partitionBy(F.lit(0))).alias("total"),
    )
    start = F.col("base") + F.sum("size").over(within) - F.col("size")
    placed = spread.join(broadcast_if_small(stage(bases, "shard-bases")), "part").select(
        "part", "order_key", "doc_id", "size", "text_crc32",
        F.least(F.floor(start.cast("decimal(38,0)") * n_shards / F.col("total")).cast("int"), F.lit(n_shards - 1)).alias("shard"),
    )
    ranked = placed.withColumn("nth", F.row_number().over(W.partitionBy("part", "shard").orderBy("order_key", "doc_id", "size")))
    counts = ranked.groupBy("part", "shard").agg(F.count("*").alias("n"))
    # at most one row per (partition, shard) that meet: partitions + shards rows
    firsts = counts.select(
        "part", "shard",
        F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"),
    )
    return ranked.join(broadcast_if_small(stage(firsts, "shard-firsts")), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(load(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(n)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ([{','.join(map(str, table))}]::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


ORACLE_SQL = {
    "op5_sharding": f"""
WITH sized AS (
  SELECT doc_id, md5(coalesce(text, '')) AS order_key, coalesce(text, '') AS t,
         (strlen(coalesce(text, '')) + 8)::BIGINT AS size FROM documents),
placed AS (
  SELECT *, least(23, ((sum(size) OVER (ORDER BY order_key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)
                       * 24 // sum(size) OVER ())::INT) AS shard FROM sized)
SELECT doc_id, size, {_crc32_sql('t')} AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY order_key, doc_id, size) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM placed""",
}

QUERIES = {"op5_sharding": op5_sharding}
