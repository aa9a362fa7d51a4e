"""Pair scoring by boosted trees, blending, stacking and rule mining on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preset:
    """Size of one boosted model. ``positive_weight`` under 1 makes false matches dearer."""

    trees: int
    depth: int
    rate: float = 0.1
    least_leaf: int = 1
    bins: int = 64
    positive_weight: float = 1.0
    sampled: float = 1.0


PRESETS = {
    "first": Preset(300, 6), "second": Preset(500, 7), "fourth": Preset(700, 8), "hard_negative": Preset(900, 8), "v8": Preset(750, 7), "v11": Preset(850, 7),
    "v13_a": Preset(1200, 8, 0.025), "v13_b": Preset(1200, 8, 0.025, least_leaf=15, sampled=0.8), "asymmetric": Preset(1200, 8, 0.025, least_leaf=15, positive_weight=0.25),
    "small_a": Preset(12, 4, 0.2), "small_b": Preset(12, 5, 0.2, least_leaf=5, sampled=0.8),
}


def assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(features)


def fit(features: DataFrame, columns: list[str], preset: Preset, seed: int = 42):
    """A boosted model on ``label``."""
    data = assembled(features, columns).withColumn("_w", F.when(F.col("label") == 1, preset.positive_weight).otherwise(1.0))
    gbt = GBTClassifier(labelCol="label", featuresCol="_x", weightCol="_w", maxIter=preset.trees, maxDepth=preset.depth, stepSize=preset.rate, minInstancesPerNode=preset.least_leaf, maxBins=preset.bins, subsamplingRate=preset.sampled, seed=seed, maxMemoryInMB=512)
    return gbt.fit(data.select("label", "_x", "_w"))


def ensemble(train: DataFrame, test: DataFrame, columns: list[str], a: Preset, b: Preset, weight: float = 0.5) -> DataFrame:
    """``test`` with p_a, p_b and their blend ``probability``."""
    models = [fit(train, columns, p).setProbabilityCol(f"_pv{i}").setRawPredictionCol(f"_rv{i}").setPredictionCol(f"_yv{i}") for i, p in enumerate((a, b))]
    out = assembled(test, columns)
    for i, (m, name) in enumerate(zip(models, ("p_a", "p_b"), strict=True)):
        out = m.transform(out).withColumn(name, vector_to_array(f"_pv{i}")[1]).drop(f"_pv{i}", f"_rv{i}", f"_yv{i}")
    return out.drop("_x").withColumn("probability", F.col("p_a") * weight + F.col("p_b") * (1 - weight))


def stacked(rows: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """Out-of-fold logistic stacking of model outputs; ``fold`` is 0..folds-1 by entity."""
    data = assembled(rows, columns)
    out = None
    for k in range(folds):
        model = LogisticRegression(labelCol="label", featuresCol="_x", regParam=0.01, maxIter=30).fit(data.filter(F.col("fold") != k).select("label", "_x"))
        part = model.transform(data.filter(F.col("fold") == k)).withColumn("stacked", vector_to_array("probability")[1])
        part = part.drop("_x", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def pure_leaves(rows: DataFrame, columns: list[str], depth: int = 4, least: int = 50) -> DataFrame:
    """Leaves of a shallow tree with their size and purity: candidates for hand-checked rules."""
    data = assembled(rows, columns)
    model = DecisionTreeClassifier(labelCol="label", featuresCol="_x", maxDepth=depth, minInstancesPerNode=least, seed=7).setLeafCol("leaf").fit(data.select("label", "_x"))
    leaves = model.transform(data).groupBy("leaf").agg(F.count(F.lit(1)).alias("pairs"), F.avg("label").alias("purity"))
    return leaves.orderBy(F.desc("purity"), F.desc("pairs"))


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by their share of the model's gain."""
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
