"""Registered pipelines: preprocessor, feature engineer, model and labels as one unit, with versions and aliases."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import from_rows
from . import models
from .features import AutoFeatureEngineer, assemble
from .preprocess import AutoPreprocessor
from .scratch import sent
from .tracking import TrackingStore

DEFAULT_NAME = "automl-pipeline"


@dataclass
class RegistryRecord:
    run_id: str
    model_name: str
    model_uri: str
    artifact_path: str
    alias: str
    model_version: str | None = None


@dataclass
class ModelInfo:
    model_name: str
    model_uri: str
    latest_version: str | None
    alias: str


class FullPipeline:
    """Raw rows to predictions."""

    def __init__(self, preprocessor: AutoPreprocessor, engineer: AutoFeatureEngineer, model, labels: models.Labels | None):
        self.preprocessor, self.engineer, self.model, self.labels = preprocessor, engineer, model, labels

    def features(self, df: DataFrame) -> DataFrame:
        """All columns of df as one struct `row`, and the feature columns."""
        rows = df.withColumn("__row", F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))) if df.columns else df
        made = self.preprocessor.transform(rows, keep=["__row"])
        return self.engineer.transform(made, keep=["__row"])

    def predict(self, df: DataFrame) -> DataFrame:
        """The columns of df and `prediction`."""
        vectors = assemble(self.features(df), self.engineer.get_feature_names_out(), ["__row"])
        out = self.model.transform(vectors)
        value = self.labels.decode(F.col("prediction")) if self.labels else F.col("prediction")
        return out.withColumn("__value", value).select(*(F.col("__row")[c].alias(c) for c in df.columns if c != "prediction"), F.col("__value").alias("prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        for i, (c, table) in enumerate(sorted(self.preprocessor.dictionaries.items())):
            table.withColumn("column", F.lit(c)).write.mode("overwrite").parquet(f"{path}/dictionaries/{i}")
        state = {"preprocessor": self.preprocessor.to_json(), "engineer": self.engineer.to_json(), "labels": self.labels.values if self.labels else None, "dictionaries": sorted(self.preprocessor.dictionaries)}
        sent(spark, [(json.dumps(state, default=str),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FullPipeline:
        state = json.loads("".join(r.value for r in spark.read.text(f"{path}/state").collect()))
        tables = {c: spark.read.parquet(f"{path}/dictionaries/{i}").drop("column") for i, c in enumerate(state["dictionaries"])}
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext)
        labels = models.Labels(state["labels"]) if state["labels"] is not None else None
        return cls(AutoPreprocessor.from_json(state["preprocessor"], tables), AutoFeatureEngineer.from_json(state["engineer"]), model, labels)


def latest_version(versions: DataFrame) -> DataFrame:
    """(name, latest_version) of (name, version, created): the newest; missing times count as 0, of equal ones the larger version."""
    return versions.groupBy("name").agg(F.max_by("version", F.struct(F.coalesce("created", F.lit(0.0)), "version")).alias("latest_version"))


def resolve_uri(versions: DataFrame, aliases: DataFrame, alias: str = "production") -> DataFrame:
    """(name, uri): by alias where there is one, else by the newest version."""
    newest = aliases.where(F.col("alias") == alias).groupBy("name").agg(F.max_by("version", "changed").alias("aliased"))
    return latest_version(versions).join(newest, "name", "left").select(
        "name", F.when(F.col("aliased").isNotNull(), F.concat(F.lit("models:/"), "name", F.lit(f"@{alias}"))).otherwise(F.concat(F.lit("models:/"), "name", F.lit("/"), F.col("latest_version").cast("string"))).alias("uri")
    )


def version_by_run(versions: DataFrame, run_id: str) -> DataFrame:
    """The newest version of each name that a run made."""
    return latest_version(versions.where(F.col("run_id") == run_id)).withColumnRenamed("latest_version", "version")


class Registry:
    def __init__(self, spark: SparkSession, path: str, model_name: str = DEFAULT_NAME):
        self.spark, self.model_name = spark, model_name
        self.tracking = TrackingStore(spark, path)
        self.store = self.tracking.store

    @staticmethod
    def build_full_pipeline(preprocessor, engineer, model, labels=None) -> FullPipeline:
        return FullPipeline(preprocessor, engineer, model, labels)

    def register_pipeline(self, *, full_pipeline: FullPipeline, params: dict, metrics: dict, tags: dict | None = None, artifact_path: str = "full_pipeline", alias: str = "production") -> RegistryRecord:
        run_id = self.tracking.start("registered-full-automl-pipeline")
        self.tracking.log(run_id, params, metrics, tags or {})
        uri = f"{self.store.path}/artifacts/{run_id}/{artifact_path}"
        full_pipeline.save(self.spark, uri)
        version = self.store.add_version(self.model_name, run_id, uri)
        self.set_alias(version, alias)
        return RegistryRecord(run_id, self.model_name, uri, artifact_path, alias, str(version))

    def _versions(self) -> DataFrame:
        return self.store.read("model_versions").where(F.col("name") == self.model_name)

    def get_latest_version(self) -> str | None:
        r = latest_version(self._versions()).first()
        return str(r.latest_version) if r else None

    def set_alias(self, version: int | str, alias: str = "production") -> None:
        if self._versions().where(F.col("version") == int(version)).isEmpty():
            raise LookupError(f"{self.model_name!r} has no version {version}")
        self.store.append("model_aliases", [(self.model_name, alias, int(version), time.time())])

    def get_model_uri(self, alias: str = "production") -> str:
        r = resolve_uri(self._versions(), self.store.read("model_aliases"), alias).first()
        if r is None:
            raise RuntimeError(f"no version of {self.model_name!r} is registered")
        return r.uri

    def get_model_info(self, alias: str = "production") -> ModelInfo:
        return ModelInfo(self.model_name, self.get_model_uri(alias), self.get_latest_version(), alias)

    def _path(self, uri: str) -> str:
        """Where the pipeline that a models:/ URI names lies; other URIs are paths."""
        if not uri.startswith("models:/"):
            return uri
        name, at, alias = uri.removeprefix("models:/").partition("@")
        versions = self.store.read("model_versions")
        if at:
            r = self.store.read("model_aliases").where((F.col("name") == name) & (F.col("alias") == alias)).agg(F.max_by("version", "changed")).first()
            version = r[0]
        else:
            name, _, version = name.rpartition("/")
        found = versions.where((F.col("name") == name) & (F.col("version") == (int(version) if version is not None else -1))).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("created")))).where("n = 1").first()
        if found is None:
            raise LookupError(f"nothing is registered as {uri}")
        return found.uri

    def load_model(self, model_uri: str | None = None) -> FullPipeline:
        return FullPipeline.load(self.spark, self._path(model_uri or self.get_model_uri()))

    def predict(self, rows: DataFrame | list[dict], model_uri: str | None = None) -> DataFrame:
        return self.load_model(model_uri).predict(from_rows(self.spark, rows) if isinstance(rows, list) else rows)

    def info(self) -> dict:
        return asdict(self.get_model_info())
