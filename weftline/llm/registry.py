"""Queries of all training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bfd_packing, cross_entropy, fm_quality, html_main, line_rules, mixing, neardup, packing, token_counts

MODULES = (fm_quality, bfd_packing, token_counts, line_rules, html_main, mixing, cross_entropy, neardup, ann, packing)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
