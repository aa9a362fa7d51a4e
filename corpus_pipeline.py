"""A training-data pipeline over ``documents``: line-frequency rules, quality classifier, near-duplicate removal,
mixing to target weights, packing. Each stage gets what its predecessor kept; all but the last return the columns of
``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import _base, fm_quality, line_rules, mixing, neardup, packing


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs)


STAGES = [
    ("quality_rules", line_rules.stage),
    ("quality_classifier", fm_quality.stage),
    ("near_duplicates", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", _pack),
]

#: Trained weights, sampled signatures and tokenizer ids have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; each stage is written in the shared folder and read again. What a stage wrote on its
    way, and the documents it read, are deleted once its own result is written."""
    docs, begin = _base.read(spark, sf_dir, "documents"), _base.mark()
    for name, stage in STAGES[:-1]:
        docs = _base.materialize(stage(spark, docs, sf_dir), name)
        _base.release(begin, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
