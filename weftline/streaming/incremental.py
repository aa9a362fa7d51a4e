"""Incremental resolution: new source-1 entities stream in against a static index of the other sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..sources import tables


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Entity files as a stream."""
    return tables.with_nulls(spark.readStream.schema(tables.ENTITY).option("sep", "\t").option("header", True).csv(folder))


def _versions(spark: SparkSession, state_path: str) -> list[int]:
    """Whole versions of the assignment table, oldest first: those whose writer has committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(state_path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(state_path))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{state_path}/{n}/_SUCCESS")))


def current(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The newest whole version of the assignment table."""
    found = _versions(spark, state_path)
    return spark.read.parquet(f"{state_path}/v={found[-1]}") if found else None


def resolve_batch(new: DataFrame, others: DataFrame, claims_of: Callable[[DataFrame], DataFrame], state_path: str, batch: int) -> None:
    """Merge one batch of new entities into the assignment table.

    A later, more probable claim takes a candidate from its earlier claimant, so the table is keyed by candidate and
    written anew with the best of old and new, as the version of the batch's number. A version counts once its writer
    has committed; it is made from the newest version of an earlier batch, so a batch that is repeated after a crash
    gives the same table and nothing is lost at any moment. The version before is kept, older ones are deleted. The
    state belongs to one checkpoint, whose batch numbers only grow."""
    spark = new.sparkSession
    claims = claims_of(new.unionByName(others)).select("source1_entity_id", "matched_entity_id", "probability")
    before = [v for v in _versions(spark, state_path) if v < batch]
    if before:
        claims = claims.unionByName(spark.read.parquet(f"{state_path}/v={before[-1]}"))
    resolve.injective_by_candidate(claims).write.mode("overwrite").parquet(f"{state_path}/v={batch}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for v in before[:-1]:
        fs.delete(path(f"{state_path}/v={v}"), True)


def start(stream: DataFrame, others: DataFrame, claims_of: Callable[[DataFrame], DataFrame], state_path: str, checkpoint: str):
    """A streaming query that keeps the assignment table at ``state_path``; processes what is there, then stops."""
    run = lambda batch, number: resolve_batch(batch, others, claims_of, state_path, number)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, stream: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events per type and window with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
