"""Table profiling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of each column, in one pass."""
    return df.agg(*[F.coalesce(F.count_if(F.col(c).isNull()), F.lit(0)).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """Exact interpolated percentiles."""
    p = lambda q, name: F.percentile(column, F.lit(q)).alias(name)
    return df.agg(F.count(F.lit(1)).alias("n"), F.median(column).alias("median"), p(0.75, "p75"), p(0.9, "p90"), p(0.95, "p95"), p(0.99, "p99"))


def histogram(df: DataFrame, column: str, bounds: tuple[tuple[int, str], ...], rest: str) -> DataFrame:
    """Counts per labelled bucket, in the order of their values."""
    label = F.lit(rest)
    for top, name in reversed(bounds):
        label = F.when(F.col(column) <= top, name).otherwise(label)
    return df.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low")).orderBy("low")
