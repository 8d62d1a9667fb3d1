"""Global order without a single task: range partitions, their sums, and sums within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonest.session import materialize, shuffle_partitions


def running_total(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows up to this one in ``order`` (which must be total)."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    ordered = materialize(ordered.withColumn("_amount", amount), "ordered")
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_amount").over(inside) + F.col("_offset")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, total).drop("_part", "_amount", "_offset")


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add ``name``: the place of each row in ``order``, from 1."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def percentile_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the tie-aware percentile rank of ``value`` among all rows; 0.5 if there is one row only.

    Ranks are worked out on the distinct values and joined back. Values that more than a thousandth of all rows
    share, a thousand at most, go to the rows; the others meet them by value.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = running_total(counts, [F.col("_v").asc()], F.col("_n"), "_upto")
    total = df.agg(F.count("*").alias("_all"))
    middle = (F.col("_upto") - F.col("_n") + (F.col("_n") - 1) / 2.0) / (F.col("_all") - 1)
    ranks = counts.join(F.broadcast(total)).select("_v", F.when(F.col("_all") < 2, 0.5).otherwise(middle).alias("_rank"), (F.col("_n") * 1000 > F.col("_all")).alias("_hot"))
    ranks = materialize(ranks, "ranks")
    hot = F.broadcast(ranks.where("_hot").select("_v", F.col("_rank").alias(name), F.lit(True).alias("_hot")))
    met = df.join(hot, df[value].eqNullSafe(F.col("_v")), "left").drop("_v")
    rest = met.where("_hot is null").drop("_hot", name)
    rest = rest.join(ranks.where("not _hot").select("_v", F.col("_rank").alias(name)), rest[value].eqNullSafe(F.col("_v"))).drop("_v")
    return met.where("_hot").drop("_hot").unionByName(rest)
