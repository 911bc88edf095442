"""The HTTP routes' work as plain functions, with the same checks. A web layer may wrap them: ServiceError carries the
status it should answer with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import col, normalize_missing
from ..sources.readers import from_rows, read_table
from .automl import run_automl
from .registry import Registry
from .split import detect_task_type

TASKS = ("classification", "regression", "auto")
RESPONSE = ("run_id", "best_score", "best_model_family", "best_params", "model_name", "model_version", "model_uri", "endpoint_url", "task_type", "metric", "target_column")


class ServiceError(ValueError):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Service:
    def __init__(self, spark: SparkSession, store: str, search: dict | None = None):
        self.spark, self.store, self.search = spark, store, search

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}

    def model_info(self) -> dict:
        try:
            return Registry(self.spark, self.store).info()
        except Exception as e:
            raise ServiceError(404, str(e)) from e

    def predict(self, rows: list[dict], model_uri: str | None = None) -> dict:
        if not rows:
            raise ServiceError(422, "rows must not be empty")
        try:
            registry = Registry(self.spark, self.store)
            uri = model_uri or registry.get_model_uri()  # resolved once, so that answer and model are the same
            found = registry.predict(rows, uri)
            return {"model_uri": uri, "predictions": [r["prediction"] for r in found.select("prediction").collect()]}
        except Exception as e:
            raise ServiceError(400, str(e)) from e

    def train(self, rows: list[dict], target_column: str, metric: str | None = None, n_trials: int = 5, task_type: str = "auto") -> dict:
        if not rows or not target_column or not 1 <= n_trials <= 200 or task_type not in TASKS:
            raise ServiceError(422, "rows, a target_column, 1 to 200 trials and a known task_type are needed")
        try:
            df = from_rows(self.spark, rows)
        except ValueError as e:
            raise ServiceError(400, str(e)) from e
        return self.train_frame(df, target_column, metric, n_trials, task_type)

    def upload_train(self, path: str, target_column: str, metric: str | None = None, n_trials: int = 5, task_type: str = "auto") -> dict:
        try:
            df = read_table(self.spark, path)
        except ValueError as e:
            raise ServiceError(400, str(e)) from e
        return self.train_frame(df, target_column, metric, n_trials, task_type)

    def train_frame(self, df: DataFrame, target_column: str, metric: str | None, n_trials: int, task_type: str) -> dict:
        if df.isEmpty():
            raise ServiceError(400, "Dataset is empty.")
        if target_column not in df.columns:
            raise ServiceError(400, f"Target column {target_column!r} was not found.")
        df = normalize_missing(df).where(col(target_column).isNotNull())
        if df.isEmpty():
            raise ServiceError(400, "No rows remain after dropping missing target values.")
        task = detect_task_type(df, target_column) if task_type == "auto" else task_type
        try:
            result = run_automl(df, target_column, metric or ("accuracy" if task == "classification" else "r2"), n_trials, task, store=self.store, search=self.search)
        except Exception as e:
            raise ServiceError(400, str(e)) from e
        return {k: result[k] for k in RESPONSE}
