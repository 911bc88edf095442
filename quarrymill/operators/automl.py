"""From a table and a target to a registered pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, normalize_missing
from .features import AutoFeatureEngineer
from .preprocess import AutoPreprocessor, split_features_target
from .registry import DEFAULT_NAME, Registry
from .search import HPOEngine
from .split import detect_task_type, holdout
from .tracking import TrackingStore

KEY = "__row_key"


def with_key(df: DataFrame, key: str | None) -> DataFrame:
    """df with a key column. Without one, rows are keyed by a hash of all values: equal rows fall together, in any run."""
    return df.withColumn(KEY, col(key).cast("string") if key else F.concat_ws(":", F.xxhash64(*map(col, df.columns)).cast("string"), F.md5(F.to_json(F.struct(*map(col, df.columns))))))


def profile(df: DataFrame) -> dict[str, int]:
    return {"n_rows": df.count(), "n_columns": len(df.columns)}


def run_automl(
    df: DataFrame,
    target_column: str,
    metric: str | None = "accuracy",
    n_trials: int = 20,
    task_type: str = "classification",
    registered_model_name: str = DEFAULT_NAME,
    *,
    store: str,
    key: str | None = None,
    fit_on_train_only: bool = False,
    drop_key: bool = False,
    search: dict | None = None,
) -> dict:
    """The run's result. store: the folder of the run store. key: a column that tells rows apart; it is a feature too
    unless drop_key. fit_on_train_only: fit preprocessing without the hold-out part (all rows otherwise). search: further
    arguments of HPOEngine."""
    spark = df.sparkSession
    split_features_target(df, target_column)
    df = normalize_missing(df)
    task = detect_task_type(df, target_column) if task_type == "auto" else task_type
    metric = metric or ("accuracy" if task == "classification" else "r2")
    tracker = TrackingStore(spark, store)
    tracker.setup()
    keyed = with_key(df, key)
    raw = df.drop(key) if key and drop_key else df
    fit_rows = raw
    settings = {"random_state": 42, "test_size": 0.2} | (search or {})
    if fit_on_train_only:
        part = holdout(keyed.where(col(target_column).isNotNull()), KEY, target_column if task == "classification" else None, settings["test_size"], settings["random_state"])
        fit_rows = part.where(~F.col("is_test")).select(*map(col, raw.columns))
    preprocessor = AutoPreprocessor(encoding="onehot", scaling="standard").fit(fit_rows, target_column)
    kept = keyed.withColumnRenamed(target_column, "__target")
    source = kept if not (key and drop_key) else kept.drop(key)
    matrix = preprocessor.transform(source, keep=[KEY, "__target"])
    engineer = AutoFeatureEngineer(variance_threshold=0.01, use_pca=False, task_type=task)
    engineer.fit(preprocessor.transform(fit_rows))
    features = engineer.transform(matrix, keep=[KEY, "__target"])
    engine = HPOEngine(task_type=task, metric=metric, n_trials=n_trials, tracker=tracker, **settings)
    result = engine.optimize(features, "__target", KEY, engineer.get_feature_names_out())
    result = replace(result, trials=list(result.trials))
    registry = Registry(spark, store, registered_model_name)
    pipeline = registry.build_full_pipeline(preprocessor, engineer, result.best_model, result.labels)
    record = registry.register_pipeline(
        full_pipeline=pipeline,
        params={"target_column": target_column, "metric": metric, "task_type": task, **result.best_params},
        metrics={"best_score": result.best_score, **result.test_metrics},
        tags={"engine": "automl", "model_family": result.best_model_family},
    )
    return {
        "run_id": record.run_id,
        "best_score": result.best_score,
        "best_model_family": result.best_model_family,
        "best_params": result.best_params,
        "model": result.best_model,
        "full_pipeline": pipeline,
        "model_name": record.model_name,
        "model_version": record.model_version,
        "model_uri": record.model_uri,
        "endpoint_url": f"/automl/predict/{record.model_name}",
        "task_type": task,
        "metric": metric,
        "target_column": target_column,
        **profile(df),
    }


def predict_with_registered_model(spark, rows, store: str, model_uri: str | None = None) -> DataFrame:
    return Registry(spark, store).predict(rows, model_uri)
