"""Feature engineering over numeric columns: variance filter, polynomial terms, recursive elimination, PCA."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations_with_replacement, groupby

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def array_features(df: DataFrame, column: str, size: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """An array column as columns feature_0, feature_1 and so on; size: if unknown, that of the first row."""
    n = size or df.select(F.size(col(column))).first()[0]
    return df.select(*(col(c) for c in keep), *(F.get(col(column), i).cast("double").alias(f"feature_{i}") for i in range(n)))


def polynomial_terms(names: Sequence[str], degree: int, bias: bool = False) -> list[tuple[str, tuple[str, ...]]]:
    """(name, factors) of each term, by degree, then in column order: a, b, a^2, a b, b^2."""
    out = [("1", ())] if bias else []
    for d in range(1, degree + 1):
        for factors in combinations_with_replacement(names, d):
            powers = [(k, len(list(g))) for k, g in groupby(factors)]
            out.append((" ".join(k if p == 1 else f"{k}^{p}" for k, p in powers), factors))
    return out


def product(factors: Sequence[str]) -> Column:
    out = F.lit(1.0)
    for i, f in enumerate(factors):
        out = col(f).cast("double") if i == 0 else out * col(f)
    return out


def rfe_target(width: int, wanted: int | float | None) -> int:
    """How many features stay: half by default, a number, or a share of the width."""
    if wanted is None:
        return max(1, width // 2)
    if isinstance(wanted, float):
        if not 0 < wanted <= 1:
            raise ValueError("a share of features must lie in (0, 1]")
        return max(1, int(width * wanted))
    return wanted


def assemble(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), output: str = "features") -> DataFrame:
    """keep and one vector; the inputs get plain names first, since the assembler can't take dots in names."""
    plain = [f"f{i}" for i in range(len(names))]
    df = df.select(*(col(k) for k in keep), *(col(n).cast("double").alias(p) for n, p in zip(names, plain, strict=True)))
    return VectorAssembler(inputCols=plain, outputCol=output, handleInvalid="error").transform(df).select(*(col(k) for k in keep), output)


class AutoFeatureEngineer:
    """Stages in this order: variance, polynomial, elimination, PCA; the later two are off unless asked for."""

    def __init__(
        self,
        variance_threshold: float = 0.0,
        polynomial_degree: int | None = None,
        polynomial_include_bias: bool = False,
        use_rfe: bool = False,
        rfe_n_features: int | float | None = None,
        rfe_estimator=None,
        task_type: str = "classification",
        use_pca: bool = False,
        pca_n_components: int | float | None = None,
        random_state: int = 42,
    ):
        self.variance_threshold, self.polynomial_degree, self.polynomial_include_bias = variance_threshold, polynomial_degree, polynomial_include_bias
        self.use_rfe, self.rfe_n_features, self.rfe_estimator = use_rfe, rfe_n_features, rfe_estimator
        self.task_type, self.use_pca, self.pca_n_components, self.random_state = task_type, use_pca, pca_n_components, random_state
        self.state: dict | None = None

    def fit(self, df: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> AutoFeatureEngineer:
        """features: all columns but the target, if not given."""
        names = list(features) if features is not None else [c for c in df.columns if c != target]
        got = df.agg(*(F.var_pop(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names))).first() if names else []
        kept = [c for c, v in zip(names, got, strict=True) if v is not None and v > self.variance_threshold]
        if not kept:
            raise ValueError(f"no feature has a variance above {self.variance_threshold}")
        terms = polynomial_terms(kept, self.polynomial_degree, self.polynomial_include_bias) if (self.polynomial_degree or 1) > 1 else [(c, (c,)) for c in kept]
        chosen = [n for n, _ in terms]
        self.state = {"original": names, "kept": kept, "terms": terms, "chosen": chosen, "pca": None}
        if self.use_rfe:
            if target is None:
                raise ValueError("recursive elimination needs a target")
            self.state["chosen"] = chosen = self._eliminate(self._terms(df, [target]), chosen, target, rfe_target(len(names), self.rfe_n_features))
        if self.use_pca:
            self.state["pca"] = self._components(self._terms(df), chosen)
        return self

    def _terms(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*(col(k) for k in keep), *(product(f).alias(n) for n, f in self.state["terms"] if n in self.state["chosen"]))

    def _eliminate(self, df: DataFrame, names: list[str], target: str, wanted: int) -> list[str]:
        """Drops the least important feature until `wanted` are left; of equal ones the later goes."""
        names = list(names)
        label = df.select(col(target).cast("double").alias("label"), *(col(n) for n in names)).persist()
        try:
            while len(names) > wanted:
                kind = RandomForestClassifier if self.task_type == "classification" else RandomForestRegressor
                extra = {} if self.task_type == "classification" else {"featureSubsetStrategy": "all"}
                estimator = self.rfe_estimator or kind(numTrees=100, seed=self.random_state, **extra)
                model = estimator.fit(assemble(label, names, ["label"]), {estimator.getParam("labelCol"): "label", estimator.getParam("featuresCol"): "features"})
                weights = np.abs((model.featureImportances if hasattr(model, "featureImportances") else model.coefficients).toArray())
                names.pop(len(names) - 1 - int(weights[::-1].argmin()))
        finally:
            label.unpersist()
        return names

    def _components(self, df: DataFrame, names: list[str]) -> dict:
        """Centred principal components. Spark ML's learner gives the loadings, from the covariance matrix, which it adds up
        in a tree; its own projection does not centre, so the means are kept beside them. The largest loading of each is
        positive."""
        n = len(names)
        vectors = assemble(df, names)
        means = vectors.agg(Summarizer.mean(F.col("features"))).first()[0].toArray()
        model = PCA(k=n, inputCol="features", outputCol="pca").fit(vectors)
        loadings, share = model.pc.toArray(), model.explainedVariance.toArray()
        k = self.pca_n_components
        if k is None:
            k = n
        elif isinstance(k, float):
            k = int(np.searchsorted(np.cumsum(share), k, side="left")) + 1
        loadings = loadings[:, : min(k, n)]
        signs = np.sign(loadings[np.abs(loadings).argmax(0), range(loadings.shape[1])])
        return {"means": means.tolist(), "loadings": (loadings * signs).T.tolist(), "variance": share[: loadings.shape[1]].tolist()}

    def _check_is_fitted(self) -> dict:
        if self.state is None:
            raise RuntimeError("AutoFeatureEngineer must be fitted before transform().")
        return self.state

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        s = self._check_is_fitted()
        if not s["pca"]:
            return self._terms(df, keep)
        factors = dict((n, f) for n, f in s["terms"])
        centred = [product(factors[n]) - F.lit(m) for n, m in zip(s["chosen"], s["pca"]["means"], strict=True)]
        out = [sum((x * F.lit(w) for x, w in zip(centred, row, strict=True)), F.lit(0.0)).alias(f"pca_{i + 1}") for i, row in enumerate(s["pca"]["loadings"])]
        return df.select(*(col(k) for k in keep), *out)

    def fit_transform(self, df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, target, features).transform(df, keep)

    def get_feature_names_out(self) -> list[str]:
        s = self._check_is_fitted()
        return [f"pca_{i + 1}" for i in range(len(s["pca"]["loadings"]))] if s["pca"] else [n for n, _ in s["terms"] if n in s["chosen"]]

    def selected_original_features(self) -> list[str]:
        return list(self._check_is_fitted()["kept"])

    def to_json(self) -> str:
        names = ("variance_threshold", "polynomial_degree", "polynomial_include_bias", "use_rfe", "rfe_n_features", "task_type", "use_pca", "pca_n_components", "random_state")
        return json.dumps({"params": {k: getattr(self, k) for k in names}, "state": self._check_is_fitted()})

    @classmethod
    def from_json(cls, text: str) -> AutoFeatureEngineer:
        data = json.loads(text)
        made = cls(**data["params"])
        made.state = data["state"]
        return made
