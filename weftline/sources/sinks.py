"""Writers: tab-separated results, Parquet, ordered result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, quoted: bool = True, mode: str = "overwrite") -> None:
    """Tab-separated with header. Overwriting deletes the old files first; write to a new path where a reader must never find none."""
    writer = df.write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "")
    (writer if quoted else writer.option("quote", "").option("escapeQuotes", False)).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def result_lists(first: DataFrame, matches: DataFrame, spine: str = "entity_id") -> DataFrame:
    """(source1_entity_id, matched_entity_ids): one row for each entity of ``first``, ids by probability then id.

    ``matches``: source1_entity_id, matched_entity_id and perhaps probability."""
    p = -F.col("probability") if "probability" in matches.columns else F.lit(0)
    order = F.array_sort(F.collect_set(F.struct(p.alias("p"), F.col("matched_entity_id").alias("m"))))
    lists = matches.groupBy("source1_entity_id").agg(F.array_join(F.transform(order, lambda x: x["m"]), ",").alias("matched_entity_ids"))
    out = first.select(F.col(spine).alias("source1_entity_id")).join(lists, "source1_entity_id", "left")
    return out.withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit("")))


def write_results(first: DataFrame, matches: DataFrame, path: str) -> None:
    """Result lists in entity order."""
    write_tsv(result_lists(first, matches).orderBy("source1_entity_id"), path, quoted=False)


def scrub_quotes(df: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """A cell that is only quotes becomes empty; stray quotes go."""
    return df.withColumn(column, F.regexp_replace(F.coalesce(F.col(column), F.lit("")), '"', ""))


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
