"""Op 1: contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.llm.common import stored


def byte_shards(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text",
    overhead: int = 8, ranges: int | None = None,
) -> DataFrame:
    """Cut the documents, in order of id, into ``shards`` runs of near-equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``. Rows are
    range-partitioned by (id, text hash); each partition sends one total, the totals'
    running sum gives every partition its offset, and a running sum inside the
    partition gives every row its place among all bytes. A row belongs to the shard in
    which its middle byte lies. Only sizes and checksums are shuffled, never texts.

    Rows with a null id come first; rows of one id are ordered by their text's hash,
    equal rows are interchangeable. A text of any length is one row of its size, so that a shard
    may be larger than the others by one text. An empty table gives no rows. Other columns of
    ``docs`` are ignored, whatever their names.

    Returns id, size, text_crc32, global_row, first_byte, shard, slot.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
    )
    # Written once, so that a lost executor cannot deal the ranges out anew.
    ranged = stored(
        sized.repartitionByRange(ranges, F.col(id_col).asc_nulls_first(), F.col("tie"))
        .withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per range: the only step in a single task, bounded by ``ranges``.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(F.col(id_col).asc_nulls_first(), "tie", "size", "text_crc32")
    placed = (
        ranged.join(F.broadcast(offsets), "part")
        .withColumn("global_row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn(
            "first_byte",
            F.col("bytes_before") - F.col("size")
            + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn(
            "shard",
            F.least(
                F.lit(shards - 1),
                F.expr(f"((2 * first_byte + size) * {shards}) div (2 * all_bytes)"),
            ).cast("int"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("global_row").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        id_col, "size", "text_crc32", "global_row", "first_byte", "shard",
        (F.col("global_row") - F.col("start")).alias("slot"),
    )
