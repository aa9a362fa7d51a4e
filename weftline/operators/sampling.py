"""Deterministic sampling, splitting and labelling of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A reproducible random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def quota(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each label."""
    w = Window.partitionBy(label).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def part_of(key: Column, parts: int) -> Column:
    """Part 0..parts-1 of an entity, equal in every engine that has md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % parts


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with label 1 where the truth has the pair."""
    keys = ["source1_entity_id", "matched_entity_id"]
    known = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    return candidates.join(known, keys, "left").withColumn("label", F.coalesce("_t", F.lit(0)).cast("int")).drop("_t")


def capped(rows: DataFrame, positives: int = 3, negatives: int = 5) -> DataFrame:
    """Per source-1 entity the first pairs of each label, by candidate id."""
    w = Window.partitionBy("source1_entity_id", "label").orderBy("matched_entity_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.when(F.col("label") == 1, positives).otherwise(negatives)).drop("_r")


def colocated_negatives(entities: DataFrame, truth: DataFrame, n: int, seed: int, least: int = 15) -> DataFrame:
    """``n`` pairs at one long address that are no match: the hard negatives, drawn by hash. All pairs at an address take
    part, so an address with very many entities on both sides is dear; only the ``n`` best of each task leave it."""
    e = entities.filter(F.char_length("addr") >= least).select("entity_id", "addr", "country")
    first = F.col("entity_id").startswith("S1-")
    a = e.filter(first).withColumnRenamed("entity_id", "source1_entity_id")
    b = e.filter(~first).withColumnRenamed("entity_id", "matched_entity_id")
    pairs = a.join(b, ["addr", "country"]).select("source1_entity_id", "matched_entity_id")
    pairs = pairs.join(truth, ["source1_entity_id", "matched_entity_id"], "left_anti")
    key = F.concat("source1_entity_id", F.lit("|"), "matched_entity_id")
    return pairs.orderBy(draw(key, seed), "source1_entity_id", "matched_entity_id").limit(n)


def hard_negatives(features: DataFrame) -> DataFrame:
    """Non-matches that look alike in name or place."""
    return features.filter("label = 0 and (name_token_jaccard >= 0.5 or house_match = 1 or postal_exact = 1 or address_exact = 1)")


def easy_negatives(features: DataFrame) -> DataFrame:
    return features.filter("label = 0 and name_token_jaccard < 0.2 and house_match = 0 and address_exact = 0")
