"""Model families, their search spaces, and the label dictionary.

The boosted families are `trees.Booster`, by level or by best leaf. Forests are Spark ML's where its learner can say what
is asked, else `trees.Forest`: for a minimum size of splits that the leaves' minimum doesn't imply, and for depths over
Spark's 30.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, lookup
from .trees import Booster, Forest

#: The search space of each family. ("int", low, high), ("float", low, high), ("log", low, high) or ("choice", ...).
SPACES = {
    "random_forest": {"n_estimators": ("int", 50, 500), "max_depth": ("int", 3, 30), "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10), "unlimited_depth": ("choice", False, True)},
    "xgboost": {"n_estimators": ("int", 50, 500), "max_depth": ("int", 3, 12), "learning_rate": ("log", 0.001, 0.3), "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0), "reg_alpha": ("log", 1e-8, 10.0)},
    "lightgbm": {"num_leaves": ("int", 20, 300), "learning_rate": ("log", 0.001, 0.3), "n_estimators": ("int", 50, 500), "min_child_samples": ("int", 5, 100), "feature_fraction": ("float", 0.5, 1.0)},
}
FAMILIES = tuple(SPACES)
DEEPEST = 30


def available(families: list[str] | None) -> list[str]:
    """The families asked for that exist, in a fixed order; others are ignored."""
    return [f for f in FAMILIES if families is None or f in families]


def resolved(family: str, drawn: dict) -> dict:
    """Drawn values as the family's parameters: an unlimited depth is None."""
    params = {k: v for k, v in drawn.items() if k != "unlimited_depth"}
    if drawn.get("unlimited_depth"):
        params["max_depth"] = None
    return params


def build(family: str, params: dict, task: str, classes: int = 2, seed: int = 42, max_trees: int | None = None):
    """An unfitted estimator over (features, label). max_trees caps the trees, a cost knob that is off unless set."""
    trees = min(params["n_estimators"], max_trees or params["n_estimators"]) if family in SPACES else 0
    kind = {"task": task, "classes": classes, "trees": trees, "seed": seed}
    if family == "random_forest":
        depth, split, leaf = params["max_depth"], params.get("min_samples_split", 2), params["min_samples_leaf"]
        if depth is None or depth > DEEPEST or split > 2 * leaf:
            return Forest(**kind, depth=depth, least_to_split=split, least_rows=leaf)
        common = {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf, "seed": seed}
        return RandomForestClassifier(**common) if task == "classification" else RandomForestRegressor(featureSubsetStrategy="all", **common)
    if family == "xgboost":
        return Booster(**kind, depth=params["max_depth"], rate=params["learning_rate"], subsample=params["subsample"], column_share=params["colsample_bytree"], alpha=params["reg_alpha"])
    if family == "lightgbm":
        return Booster(**kind, depth=None, leaves=params["num_leaves"], rate=params["learning_rate"], least_rows=params["min_child_samples"], column_share=params["feature_fraction"], l2=0.0, least_weight=1e-3)
    raise ValueError(f"Unsupported model family: {family}")


class Labels:
    """Sorted class values and their numbers; numbers sort as numbers."""

    def __init__(self, values: list):
        self.values = sorted(values)

    @classmethod
    def of(cls, df: DataFrame, target: str, most: int = 10_000) -> Labels:
        found = [r[0] for r in df.select(col(target)).where(col(target).isNotNull()).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} classes")
        return cls(found)

    def encode(self, value: Column) -> Column:
        return lookup(value, {v: float(i) for i, v in enumerate(self.values)}).cast("double")

    def decode(self, value: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.values)), value.cast("int"))


def predictions(model, df: DataFrame, classes: int) -> DataFrame:
    """df with p and, for classifiers, scores: the probabilities."""
    out = model.transform(df).withColumn("p", F.col("prediction"))
    return out.withColumn("scores", vector_to_array("probability")) if classes else out


def importances(model, names: list[str]) -> list[tuple[str, float]] | None:
    """(feature, importance), or None if the model has none or their number differs."""
    if not hasattr(model, "featureImportances"):
        return None
    values = model.featureImportances.toArray()
    return list(zip(names, map(float, values), strict=True)) if len(values) == len(names) else None
