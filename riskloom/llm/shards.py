"""Contiguous shards of near equal bytes from global prefix sums.

Documents get a global order (id, then checksum). Range partitions of slim rows (no texts) are written once with their
partition number; per-partition totals, a row per partition, are turned into offsets; a window inside each partition adds
the local prefix. A document goes to the shard in which the middle of its bytes falls, so each shard is within one
document of the equal target. Slots count the documents of a shard in that order.

Defined results: null text has no bytes (size 1, checksum 0); null ids come first; repeated rows take a slot each; equal
ids are ordered by checksum and size (rows equal in all three are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

SHARDS = 16


def byte_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    ranged = materialise(slim.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    offsets = materialise(offsets, "offsets")  # written, so its size is known to the planner
    total = ranged.agg(F.sum("size")).first()[0] or 1

    local = Window.partitionBy("part").orderBy(*keys)
    placed = ranged.select(
        *keys, "part", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(local).alias("nth")
    ).join(offsets, "part")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")  # twice the middle of the document
    placed = placed.select(
        *keys, F.least(F.floor(middle * F.lit(shards) / F.lit(2.0 * total)), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place")
    )
    placed = materialise(placed, "placed")
    first = {r["shard"]: r["place"] for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()}  # a row per shard
    start = F.create_map(*[x for k, v in (first or {0: 0}).items() for x in (F.lit(k), F.lit(v))])
    return placed.select(*keys, "shard", (F.col("place") - F.element_at(start, F.col("shard"))).cast("long").alias("slot"))
