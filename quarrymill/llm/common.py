"""Shared by the operators of this package: shared-folder tables, worker set-up, input columns."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session without the setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quarrymill-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Scope:
    """Tables that are discarded together."""

    def __init__(self):
        self.paths: list[str] = []


_SCOPES: list[Scope] = []
#: For tables that results read lazily: they stay until the session's folder is cleaned.
STAYS = Scope()


@contextmanager
def passing(spark: SparkSession):
    """Tables written inside are discarded at its end, but for those given another scope. What is read later must be
    written with STAYS, or with a scope that lasts longer."""
    scope = Scope()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        discard(spark, *scope.paths)


def materialize(df: DataFrame, name: str, scope: Scope | None = None, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and losing an executor costs nothing.
    The table stays as long as its scope, by default that of the innermost `passing`; outside of these, until the session's folder is
    cleaned, since lazily built results still read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    (scope or (_SCOPES[-1] if _SCOPES else STAYS)).paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialize, with the table's path and without a scope, for a table that its maker discards once the next one is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no plan reads any more."""
    for path in paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver's JVM collects what refers to them; between passes, it is asked to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prepare(spark: SparkSession) -> None:
    """Lets Python workers find this package, and keeps Arrow batches of long texts small."""
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so that no further column can clash; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
