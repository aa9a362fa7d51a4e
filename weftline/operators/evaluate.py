"""Evaluation of candidates and matches against the truth, and validation of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, OTHER = "source1_entity_id", "matched_entity_id"
KEYS = [FIRST, OTHER]


def hits(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: distinct pairs predicted, true, and in both."""
    p = pairs.select(*KEYS).distinct().withColumns({"p": F.lit(1), "t": F.lit(0)})
    t = truth.select(*KEYS).distinct().withColumns({"p": F.lit(0), "t": F.lit(1)})
    both = p.unionByName(t).groupBy(*KEYS).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    s = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return both.agg(s(F.col("p"), "predicted"), s(F.col("t"), "actual"), s(F.col("p") * F.col("t"), "correct"))


def blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return hits(candidates, truth).select("actual", "correct", "predicted", F.coalesce(F.try_divide("correct", "actual"), F.lit(0.0)).alias("recall"))


def f_beta(tp: Column, predicted: Column, actual: Column, beta: float = 0.5) -> Column:
    """Both empty 1, one empty or no hit 0."""
    b = beta * beta
    return F.when((predicted == 0) & (actual == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + b) * tp / (b * actual + predicted))


def micro(pairs: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    h = hits(pairs, truth)
    return h.select("predicted", "actual", "correct", f_beta(F.col("correct"), F.col("predicted"), F.col("actual"), beta).alias("f"))


def per_entity(pairs: DataFrame, truth: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """(source1_entity_id, tp, predicted, actual) for every entity of ``spine``, or those seen in either."""
    p = pairs.select(*KEYS).distinct().withColumns({"p": F.lit(1), "t": F.lit(0)})
    t = truth.select(*KEYS).distinct().withColumns({"p": F.lit(0), "t": F.lit(1)})
    both = p.unionByName(t).groupBy(*KEYS).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    out = both.groupBy(FIRST).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("predicted"), F.sum("t").alias("actual"))
    if spine is None:
        return out
    return spine.select(FIRST).distinct().join(out, FIRST, "left").na.fill(0, ["tp", "predicted", "actual"])


def macro(pairs: DataFrame, truth: DataFrame, spine: DataFrame | None = None, beta: float = 0.5) -> DataFrame:
    """Mean F over all entities of ``spine`` (or the observed ones)."""
    each = per_entity(pairs, truth, spine).withColumn("f", f_beta(F.col("tp"), F.col("predicted"), F.col("actual"), beta))
    return each.agg(F.count(F.lit(1)).alias("entities"), F.sum("tp").alias("tp"), F.avg("f").alias("macro_f"))


def purity(rules: DataFrame, truth: DataFrame) -> DataFrame:
    """Per rule (column ``rule``): predictions, hits and their share."""
    t = truth.select(*KEYS).distinct().withColumn("_t", F.lit(1))
    joined = rules.select("rule", *KEYS).distinct().join(t, KEYS, "left")
    out = joined.groupBy("rule").agg(F.count(F.lit(1)).alias("predictions"), F.count("_t").alias("hits"))
    return out.withColumn("purity", F.col("hits") / F.col("predictions"))


def channel_efficiency(channel: DataFrame, known: DataFrame, truth: DataFrame) -> DataFrame:
    """What a channel adds: missed true pairs recovered, candidates, and their ratio."""
    missed = truth.select(*KEYS).distinct().join(known.select(*KEYS), KEYS, "left_anti")
    return hits(channel, missed).select(F.col("predicted").alias("candidates"), F.col("actual").alias("missed"), F.col("correct").alias("recovered"), F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0)).alias("efficiency"))


def coverage(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Entities with at least one and with all of their true matches among the candidates."""
    each = per_entity(candidates, truth).filter("actual > 0")
    return each.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("tp") > 0).alias("any_found"), F.count_if(F.col("tp") == F.col("actual")).alias("all_found"))


def signal_profile(pairs: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Pairs that each signal holds for, in one pass."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in signals.items()])


def threshold_grid(scored: DataFrame, truth: DataFrame, spine: DataFrame, grid: list[float], beta: float = 0.5) -> DataFrame:
    """Macro F at each threshold in one pass: conditional sums per entity, then means, unpivoted."""
    t = truth.select(*KEYS).distinct().withColumn("_t", F.lit(1))
    rows = scored.select(*KEYS, "probability").join(t, KEYS, "left").withColumn("_t", F.coalesce("_t", F.lit(0)))
    sums = [F.sum((F.col("probability") >= g).cast("int") * x).alias(f"{n}{i}") for i, g in enumerate(grid) for n, x in (("p", F.lit(1)), ("h", F.col("_t")))]
    each = rows.groupBy(FIRST).agg(*sums)
    actual = t.groupBy(FIRST).agg(F.count(F.lit(1)).alias("actual"))
    whole = spine.select(FIRST).distinct().join(each, FIRST, "left").join(actual, FIRST, "left").na.fill(0)
    f = lambda i: F.avg(f_beta(F.col(f"h{i}"), F.col(f"p{i}"), F.col("actual"), beta))
    means = whole.agg(F.array(*[F.struct(F.lit(float(g)).alias("threshold"), f(i).alias("macro_f")) for i, g in enumerate(grid)]).alias("m"))
    return means.select(F.inline("m"))


def source_threshold_grid(scored: DataFrame, truth: DataFrame, spine: DataFrame, grid: list[float], beta: float = 0.5) -> DataFrame:
    """Macro F for each pair of thresholds, one for candidates of the second source and one for the others.

    Conditional sums per entity, source and threshold in one pass; a pair's counts are the sums of its two sides."""
    t = truth.select(*KEYS).distinct().withColumn("_t", F.lit(1))
    rows = scored.select(*KEYS, "probability").join(t, KEYS, "left").withColumn("_t", F.coalesce("_t", F.lit(0)))
    second = F.col(KEYS[1]).startswith("S2-")
    sides = (("a", second), ("b", ~second))
    sums = [F.sum(((F.col("probability") >= g) & own).cast("int") * x).alias(f"{s}{n}{i}") for s, own in sides for i, g in enumerate(grid) for n, x in (("p", F.lit(1)), ("h", F.col("_t")))]
    actual = t.groupBy(FIRST).agg(F.count(F.lit(1)).alias("actual"))
    whole = spine.select(FIRST).distinct().join(rows.groupBy(FIRST).agg(*sums), FIRST, "left").join(actual, FIRST, "left").na.fill(0)
    both = lambda n, i, j: F.col(f"a{n}{i}") + F.col(f"b{n}{j}")
    cells = [
        F.struct(F.lit(float(g)).alias("s2_threshold"), F.lit(float(k)).alias("s3_threshold"), F.avg(f_beta(both("h", i, j), both("p", i, j), F.col("actual"), beta)).alias("macro_f"))
        for i, g in enumerate(grid)
        for j, k in enumerate(grid)
    ]
    return whole.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def validation(results: DataFrame, spine: DataFrame, others: DataFrame) -> DataFrame:
    """Checks of a result in list form, as named counts of violations: rows missing, rows too many, repeated entities,
    repeated ids in a list, ids unknown to the other sources, candidates claimed twice."""
    ids = F.filter(F.split("matched_entity_ids", ",", -1), lambda x: x != "")
    rows = results.select(FIRST, ids.alias("ids"))
    each = rows.select(FIRST, F.explode("ids").alias(OTHER))
    missing = spine.select(FIRST).join(results.select(FIRST), FIRST, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    extra = results.join(spine.select(FIRST), FIRST, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    repeated = results.groupBy(FIRST).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    twice = rows.filter(F.size("ids") != F.size(F.array_distinct("ids"))).agg(F.count(F.lit(1)).alias("n"))
    unknown = each.join(others.select(OTHER), OTHER, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    shared = each.groupBy(OTHER).agg(F.countDistinct(FIRST).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n"))
    named = {"missing_rows": missing, "unknown_rows": extra, "repeated_entities": repeated, "repeated_ids": twice, "unknown_ids": unknown, "shared_candidates": shared}
    out = None
    for name, n in named.items():
        row = n.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out
