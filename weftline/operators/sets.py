"""Set-like combinations of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose value is not among the other's non-null values (a hashable anti join, unlike a null-aware NOT IN)."""
    return df.join(other.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def zip_by_order(a: DataFrame, by_a: str, b: DataFrame, by_b: str) -> DataFrame:
    """Rows of both frames side by side, by their place in a total order."""
    place = lambda df, by: ranked(df, by)
    return place(a, by_a).join(place(b, by_b), "_r").drop("_r")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """Place in the order of ``by`` from 1, without one window over all rows: rows are range-partitioned and sorted,
    and each partition's rows are numbered from the sizes of those before it."""
    rows = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id())
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(by)))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")
    return rows.join(F.broadcast(before), "_p").withColumn("_r", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def fan_out_cap(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of keys that have at most ``most`` rows; the count is aggregated map-side and joined back."""
    low = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select(key)
    return pairs.join(low, key, "left_semi")


def delta_check(new: DataFrame, old: DataFrame) -> DataFrame:
    """Sizes of the old set, of what is added to it, and of the union (which must be their sum)."""
    both = new.withColumn("_n", F.lit(1)).withColumn("_o", F.lit(0)).unionByName(old.withColumn("_n", F.lit(0)).withColumn("_o", F.lit(1)))
    flags = both.groupBy(*new.columns).agg(F.max("_o").alias("_o"))
    return flags.agg(F.count_if(F.col("_o") == 1).alias("old"), F.count_if(F.col("_o") == 0).alias("added"), F.count(F.lit(1)).alias("total"))
