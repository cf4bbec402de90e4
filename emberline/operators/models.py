"""Per-cluster tree ensembles on imputed features, with staged selection by average precision."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import average_precision

FAMILIES = ("gbt", "forest")
Model = GBTClassificationModel | RandomForestClassificationModel


def medians(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """The median of each feature, 0 for one without values, in one aggregate; absent columns have none."""
    have = [c for c in features if c in rows.columns]
    row = rows.agg(F.lit(0).alias("__"), *[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in have]).first().asDict()
    return {c: float(row[c]) if row.get(c) is not None else 0.0 for c in features}


def design(rows: DataFrame, features: list[str], fills: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``rows`` with a dense ``features`` vector: nulls filled by medians, with an indicator for each; absent columns are null.

    Returns the medians too, for use on scored rows.
    """
    have = set(rows.columns)
    value = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    fills = medians(rows, features) if fills is None else fills
    made = [F.coalesce(value(c), F.lit(fills[c])).alias(f"x_{c}") for c in features] + [value(c).isNull().cast("double").alias(f"n_{c}") for c in features]
    wide = rows.select("*", *made)
    names = [f"x_{c}" for c in features] + [f"n_{c}" for c in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names), fills


def fit(rows: DataFrame, weight: float, rounds: int = 20, depth: int = 5, seed: int = 2026, family: str = "gbt") -> Model:
    """An ensemble of ``rounds`` trees on ``features`` and ``target``, positives weighted."""
    weighted = rows.withColumn("w", F.when(F.col("target") == 1, weight).otherwise(1.0)).withColumn("label", F.col("target").cast("double"))
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "w", "maxDepth": depth, "seed": seed, "subsamplingRate": 0.85}
    if family == "gbt":
        return GBTClassifier(maxIter=rounds, stepSize=0.1, featureSubsetStrategy="0.7", **common).fit(weighted)
    if family == "forest":
        return RandomForestClassifier(numTrees=rounds, **common).fit(weighted)
    raise ValueError(f"no family {family!r}")


def score(model: Model, rows: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def _stages(model: Model, rows: DataFrame, every: int) -> tuple[DataFrame, list[int]]:
    """``rows`` with an array ``__stages``: the score by the first ``every``, 2 ``every``, ... trees."""
    votes = isinstance(model, RandomForestClassificationModel)
    weights = list(model.treeWeights)
    parts: list[Column] = []
    for k, tree in enumerate(model.trees):
        tree = tree.copy().setFeaturesCol("features").setPredictionCol(f"__p{k}")
        if votes:
            tree = tree.setProbabilityCol(f"__v{k}").setRawPredictionCol(f"__r{k}")
        rows = tree.transform(rows)
        parts.append(vector_to_array(f"__v{k}")[1] if votes else F.col(f"__p{k}") * weights[k])
    steps = sorted({*range(every, len(parts) + 1, every), len(parts)})
    sums, total, done = [], F.lit(0.0), 0
    for n in steps:
        total = sum(parts[done:n], total)
        done = n
        sums.append(total)
    return rows.select("target", F.array(*sums).alias("__stages")), steps


def best_rounds(model: Model, holdout: DataFrame, every: int = 5, patience: int = 300) -> tuple[int, float]:
    """(trees, average precision): the prefix of the ensemble that ranks ``holdout`` best.

    All prefixes are scored in one pass and ranked together. The first best counts, and none that lies over ``patience`` trees
    past the best before it.
    """
    staged, steps = _stages(model, holdout, every)
    long = staged.select("target", F.posexplode("__stages").alias("stage", "score"))
    found = {r.stage: r.ap or 0.0 for r in average_precision(long, group="stage").collect()}
    best = (0, -1.0)
    for k, n in enumerate(steps):
        if best[0] and n - best[0] > patience:
            break
        if found.get(k, 0.0) > best[1]:
            best = (n, found.get(k, 0.0))
    return best


def importances(model: Model, features: list[str], most: int = 25) -> list[tuple[str, float]]:
    """The ``most`` weightiest features with their share of the total."""
    values = model.featureImportances.toArray()
    names = features + [f"{f} is null" for f in features]
    total = float(values.sum()) or 1.0
    return sorted(((n, float(v) / total) for n, v in zip(names, values, strict=True)), key=lambda x: (-x[1], x[0]))[:most]
