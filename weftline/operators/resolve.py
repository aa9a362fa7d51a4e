"""Resolution: merging claims, many-to-one assignment, shields, closure, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, OTHER, P = "source1_entity_id", "matched_entity_id", "probability"


def merge_claims(frames: list[DataFrame]) -> DataFrame:
    """All claims, the best probability per pair."""
    out = frames[0].select(FIRST, OTHER, P)
    for f in frames[1:]:
        out = out.unionByName(f.select(FIRST, OTHER, P))
    return out.groupBy(FIRST, OTHER).agg(F.max(P).alias(P))


def injective_by_candidate(claims: DataFrame) -> DataFrame:
    """Each candidate goes to its most probable claimant (ties: smallest id); claimants keep any number.

    One aggregate: the least (-probability, id) is found map-side, so a candidate with very many claims costs one row
    per task."""
    best = F.min(F.struct((-F.col(P)).alias("p"), F.col(FIRST).alias("f"))).alias("b")
    return claims.groupBy(OTHER).agg(best).select(F.col("b.f").alias(FIRST), OTHER, (-F.col("b.p")).alias(P))


def injective_by_rank(claims: DataFrame) -> DataFrame:
    """The same by row_number, which Spark limits per group before the shuffle."""
    w = Window.partitionBy(OTHER).orderBy(F.desc(P), FIRST)
    return claims.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def injective_by_similarity(claims: DataFrame, similarity: Column) -> DataFrame:
    """Only candidates with several claims are decided, by ``similarity`` over the claim's columns (ties: smallest id)."""
    w = Window.partitionBy(OTHER)
    counted = claims.withColumn("_n", F.count(F.lit(1)).over(w))
    rank = F.row_number().over(w.orderBy(F.desc("_s"), FIRST))
    decided = counted.filter("_n > 1").withColumn("_s", similarity).withColumn("_r", rank).filter("_r = 1").drop("_s", "_r")
    return counted.filter("_n = 1").unionByName(decided).drop("_n")


def with_baseline(baseline: DataFrame, claims: DataFrame, probability: float = 0.9999) -> DataFrame:
    """Earlier results outrank later claims."""
    return merge_claims([baseline.select(FIRST, OTHER).withColumn(P, F.lit(probability)), claims])


def missing_imports(scored: DataFrame, baseline: DataFrame, least: float = 0.95) -> DataFrame:
    """Confident pairs the baseline lacks."""
    return scored.filter(F.col(P) >= least).join(baseline.select(FIRST, OTHER), [FIRST, OTHER], "left_anti")


def singleton_shield(claims: DataFrame, least: float = 0.95, spared: Column | None = None) -> DataFrame:
    """Drop an entity's only match if its probability is under ``least`` (unless ``spared`` holds)."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(FIRST)) == 1
    weak = alone & (F.col(P) < least)
    return claims.withColumn("_weak", weak & ~spared if spared is not None else weak).filter("not _weak").drop("_weak")


def one_hop_closure(matches: DataFrame, classes: DataFrame) -> DataFrame:
    """Matches plus all records identical to a matched candidate. ``classes``: entity_id, class_id."""
    held = matches.join(classes.select(F.col("entity_id").alias(OTHER), "class_id"), OTHER).select(FIRST, "class_id").distinct()
    reached = held.join(classes.select("class_id", F.col("entity_id").alias(OTHER)), "class_id").select(FIRST, OTHER)
    return matches.select(FIRST, OTHER).unionByName(reached).distinct()


def identical_records(entities: DataFrame) -> DataFrame:
    """(entity_id, class_id): members of each group of equal non-empty name, address and country that has two or more;
    the smallest id names it. A group of n records takes n rows, not n * n pairs."""
    e = entities.filter("name <> '' and addr <> '' and country is not null").select("entity_id", "name", "addr", "country")
    keys = ["name", "addr", "country"]
    groups = e.groupBy(*keys).agg(F.min("entity_id").alias("class_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return e.join(groups, keys).select("entity_id", "class_id")


def ensure_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates extended by every match they lack."""
    m, c = matches.select(FIRST, OTHER), candidates.select(FIRST, OTHER)
    return c.unionByName(m.join(c, [FIRST, OTHER], "left_anti")).distinct()


def delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs of ``new`` not in ``old``."""
    return new.select(FIRST, OTHER).distinct().join(old.select(FIRST, OTHER), [FIRST, OTHER], "left_anti")
