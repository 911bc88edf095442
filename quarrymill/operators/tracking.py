"""A run store of append-only Parquet tables: runs, params, metrics, tags, artifacts; models lie beside them.

Version numbers are claimed before they are written: a writer makes a file named by the number, which exactly one can, and
takes the next number if it comes second. A writer that ends in between leaves a gap, no double.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flatten_params
from . import metrics as M
from . import models
from .scratch import sent

TABLES = {
    "runs": "run_id string, run_name string, parent_run_id string, experiment string, started double",
    "params": "run_id string, key string, value string",
    "metrics": "run_id string, key string, value double",
    "tags": "run_id string, key string, value string",
    "importances": "run_id string, feature string, importance double",
    "confusion": "run_id string, y string, p string, n long",
    "model_versions": "name string, version int, run_id string, uri string, created double",
    "model_aliases": "name string, alias string, version int, changed double",
}


@dataclass
class RunRecord:
    run_id: str | None
    artifact_paths: list[str] = field(default_factory=list)
    model_uri: str | None = None


class Store:
    """Tables under a folder that the driver and executors share. Rows are only ever added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[table])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty
        return self.spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{table}")

    def append(self, table: str, rows: list[tuple]) -> None:
        """Each call writes a folder of its own: writers at the same time don't share a commit."""
        if rows:
            sent(self.spark, rows, TABLES[table]).coalesce(1).write.parquet(f"{self.path}/{table}/{uuid.uuid4().hex}")

    def claim(self, folder: str, number: int) -> bool:
        """Whether this writer is the one that made the file for a number: made only if it isn't there, in one step (by the
        operating system on local paths, else by the file system; HDFS and its like do it atomically)."""
        where = f"{folder}/{number:010d}"
        parts = urlparse(where)
        if parts.scheme in ("file", ""):
            local = unquote(parts.path)
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        try:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        return True

    def add_version(self, name: str, run_id: str, uri: str) -> int:
        """The next version of a registered model; of several writers at a time, each gets its own."""
        newest = self.read("model_versions").where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (newest or 0) + 1
        while not self.claim(f"{self.path}/claims/{quote(name, safe='')}", version):
            version += 1
        self.append("model_versions", [(name, version, run_id, uri, time.time())])
        return version


class TrackingStore:
    def __init__(self, spark: SparkSession | None = None, path: str | None = None, experiment: str = "automl", enabled: bool = True, best_model_name: str = "automl-best-model"):
        self.enabled = enabled and path is not None
        self.experiment, self.best_model_name = experiment, best_model_name
        self.store = Store(spark, path) if self.enabled else None
        self.parent: str | None = None

    def start(self, name: str, parent: str | None = None) -> str:
        run_id = uuid.uuid4().hex
        self.store.append("runs", [(run_id, name, parent, self.experiment, time.time())])
        return run_id

    def setup(self) -> None:
        """Opens the run that trials belong to."""
        if self.enabled and self.parent is None:
            self.parent = self.start("search")

    def log(self, run_id: str, params: dict, metrics: dict, tags: dict) -> None:
        self.store.append("params", [(run_id, k, v) for k, v in flatten_params(params).items()])
        self.store.append("metrics", [(run_id, k, float(v)) for k, v in metrics.items() if v is not None and math.isfinite(v)])
        self.store.append("tags", [(run_id, k, str(v)) for k, v in tags.items()])

    def save(self, model, run_id: str, artifact: str = "model") -> str:
        uri = f"{self.store.path}/artifacts/{run_id}/{artifact}"
        model.write().overwrite().save(uri)
        return uri

    def log_trial(self, *, trial_number: int, model_family: str, params: dict, metrics: dict, model=None, feature_names: list[str] | None = None, outcomes: DataFrame | None = None, tags: dict | None = None) -> RunRecord:
        """One trial; outcomes: (y, p) rows, whose confusion matrix is kept (up to 20 labels)."""
        if not self.enabled:
            return RunRecord(None)
        self.setup()
        run_id = self.start(f"trial-{trial_number}", self.parent)
        self.log(run_id, params, metrics, {"trial_number": trial_number, "model_family": model_family, **(tags or {})})
        record = RunRecord(run_id)
        if model is not None:
            record.model_uri = self.save(model, run_id)
            record.artifact_paths.append("model")
            if found := models.importances(model, feature_names or []):
                self.store.append("importances", [(run_id, f, v) for f, v in sorted(found, key=lambda x: -x[1])[:25]])
                record.artifact_paths.append("importances")
        if outcomes is not None and (rows := M.confusion_matrix(outcomes).collect()):
            self.store.append("confusion", [(run_id, str(r.y), str(r.p), r.n) for r in rows])
            record.artifact_paths.append("confusion")
        return record

    def log_best_model(self, *, model, model_family: str, params: dict, metrics: dict, registered_model_name: str | None = None, tags: dict | None = None) -> RunRecord:
        """The winner: its bare model becomes a version of its own name."""
        if not self.enabled:
            return RunRecord(None)
        self.setup()
        run_id = self.start(f"best-{model_family}", self.parent)
        self.log(run_id, params, metrics, {"stage": "best", "model_family": model_family, **(tags or {})})
        uri = self.save(model, run_id)
        self.store.add_version(registered_model_name or self.best_model_name, run_id, uri)
        return RunRecord(run_id, ["model"], uri)
