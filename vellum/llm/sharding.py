"""Sharding: contiguous shards of near-equal bytes, cut by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import partitions, stored

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard and slot; shards are contiguous in id order and near equal in bytes.

    A row goes to the shard in which its first byte lies when all rows stand end to end in id order
    and the total is cut into `n_shards` equal parts; so a shard is off its target by less than one
    row. slot counts from 0 in a shard, without gaps.

    A null text has size 8 and crc32 0, like an empty one; null ids come first; rows that repeat an id
    stand by size, crc and a hash of the text. An empty table gives an empty table; all rows in one shard if n_shards is
    1. Extra columns are not read.

    Plan: the texts are read once and reduced to three numbers. Those rows are range-partitioned, sorted
    and written to the shared folder with their partition number, so that both later passes see the
    same partitions; the totals of the partitions (one row each) are summed up and broadcast; the sums
    within a partition need its own rows only.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("__h"),
    )
    order = ["__id", "size", "text_crc32", "__h"]
    ranged = rows.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged.sortWithinPartitions(*order), "shard-rows")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("__part")
        .agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        .withColumns(
            {
                "__byte0": F.coalesce(F.sum("__bytes").over(before), F.lit(0)),
                "__row0": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
                "__all": F.sum("__bytes").over(W.partitionBy()),
            }
        )
        .drop("__bytes", "__rows")
    )
    within = W.partitionBy("__part").orderBy(*order)
    placed = (
        ranged.withColumns(
            {"__start": F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "__nth": F.row_number().over(within) - 1}
        )
        .join(F.broadcast(totals), "__part")  # a row for each partition
        .withColumn("__start", F.col("__start") + F.col("__byte0"))
        .withColumn("__nth", F.col("__nth") + F.col("__row0"))
        .withColumn("shard", F.expr(f"cast(__start * {n_shards} div __all as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("__nth").alias("__first"))
    return (
        placed.join(F.broadcast(first), "shard")  # a row for each shard
        .select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__nth") - F.col("__first")).cast("bigint").alias("slot"))
    )
