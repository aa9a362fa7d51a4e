"""Shared plumbing: scratch tables in the shared checkpoint folder, bounded broadcasts, Arrow slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 64 << 20

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where spark.checkpoint.dir is unset, a temporary folder serves a local master
    (tests), whose executors share it; any other master is an error, since its executors could not read it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_weftline_scratch", None)
        if root is None:
            root = context._weftline_scratch = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def mark() -> int:
    """How many scratch tables there are: ``release`` may later delete those written since."""
    return len(_written)


def release(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch tables written after ``since`` but those of ``keep`` (at exit: all). Only for tables that
    nothing will read again."""
    kept, drop = {getattr(df, "_scratch", None) for df in keep}, _written[since:]
    del _written[since:]
    for spark, path in reversed(drop):
        if path in kept:
            _written.insert(since, (spark, path))
            continue
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # at exit the JVM may be gone already
            if since:
                raise
            return


def discard(*tables: DataFrame) -> None:
    """Delete these scratch tables; only for tables that nothing will read again."""
    for df in tables:
        at = next((i for i, (_, path) in enumerate(_written) if path == getattr(df, "_scratch", None)), None)
        if at is not None:
            later = _written[at + 1 :]
            del _written[at + 1 :]
            release(at)
            _written.extend(later)


atexit.register(release)


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, so that no inner name can clash, and the new name of each."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def broadcast_if_small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """Hint a broadcast only after summing the rows' bytes; a larger side is left to a shuffled join (same rows)."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cut a batch into runs of rows whose ``column`` holds about ``most`` bytes; one longer row stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = [0 if x is None else x for x in pc.binary_length(col).to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def labelled_texts(docs: DataFrame, chosen: DataFrame, rows: int, most: int, carry: dict[str, Column] | None = None) -> DataFrame:
    """(_id, _m, _text, ``carry`` and the other columns of ``chosen``): each distinct text of the ids in ``chosen``
    (column _id, at most ``rows`` of them, broadcast) once, in the order of a hash until ``rows`` texts or ``most`` bytes
    are reached. A learner's sample is thus bounded in rows and bytes, however often an id or a text is repeated."""
    own = [c.alias(n) for n, c in (carry or {}).items()]
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *own).join(F.broadcast(chosen), "_id")
    keyed = texts.withColumn("_m", F.md5(F.coalesce("_text", F.lit("")))).withColumn("_h", F.xxhash64("_id", "_m"))
    sizes = keyed.groupBy("_id", "_m", "_h").agg(F.max(F.coalesce(F.octet_length("_text"), F.lit(0))).alias("_size"))
    total, last = 0, None
    for r in sizes.orderBy("_h").limit(rows).collect():
        total += r["_size"]
        if last is not None and total > most:
            break
        last = r["_h"]
    picked = keyed.filter(F.col("_h") <= last) if last is not None else keyed.limit(0)
    return picked.dropDuplicates(["_id", "_m"]).drop("_h")
