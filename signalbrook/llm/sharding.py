"""Contiguous shards of equal bytes, from prefix sums over per-partition totals [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def assign_shards(df: DataFrame, size: str, order: list[str], n_shards: int = 16, partitions: int | None = None) -> DataFrame:
    """Put the rows of df, in the order given, into n_shards contiguous shards of nearly equal sums of size.

    Adds shard (int, from 0) and slot (long, gapless from 0 within the shard). A row belongs to the shard in
    which its first byte falls, so a shard is off its equal share by less than one row at either end.

    The rows are dealt out by ranges of the whole order and written once, each with its partition's number, so
    that a later pass or a lost executor sees the same partitions. Each partition's total is summed where it
    lies; only those totals (one row per partition: the parameter partitions, by default four times the shuffle
    partitions) are summed up in one place, and rows are numbered within their partition.

    Nulls in the order come first; a null size counts 0; rows equal in the whole order may swap places; give
    an order of several columns where one value may be frequent, so that its rows spread. An empty table gives an
    empty result. Other columns stay; shard and slot of the input are replaced.
    """
    n = partitions or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop("shard", "slot")
    keys = [f"key_{i}" for i in range(len(order))]
    # the caller's columns travel as one struct, so that no name of theirs meets one of ours
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("own"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    ascending = [F.col(k).asc_nulls_first() for k in keys]
    dealt = cut(rows.repartitionByRange(n, *ascending).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("own").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    inside = Window.partitionBy("part").orderBy(*ascending)
    run = F.sum("own").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    placed = (
        dealt.withColumns({"first_byte": run, "place": F.row_number().over(inside)})
        .join(F.broadcast(starts), "part")
        .select("row", F.expr(f"cast(least(((first_byte + bytes_before) * {n_shards}) div {total}, {n_shards - 1}) as int)").alias("shard"), (F.col("place") + F.col("rows_before") - 1).alias("place"))
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("row.*", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))
