"""Reading tables: JSON rows, CSV, Excel, Parquet and whatever else Spark reads."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .excel import read_excel

#: Strings that CSV readers of data frames commonly take as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _kind(values: list) -> T.DataType:
    """The narrowest type that holds all values: booleans alone, whole numbers, numbers, else strings."""
    import datetime

    found = {type(v) for v in values if v is not None}
    if not found:
        return T.StringType()
    if found == {bool}:
        return T.BooleanType()
    if found == {int}:
        return T.LongType() if all(abs(v) < 1 << 63 for v in values if v is not None) else T.DoubleType()
    if found <= {int, float}:
        return T.DoubleType()
    if found == {datetime.datetime}:
        return T.TimestampType()
    return T.StringType()


def from_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Rows as a frame: the union of their keys in order of appearance; a missing key is NULL. Nested values are refused."""
    if not rows:
        raise ValueError("rows must not be empty")
    names = list(dict.fromkeys(k for r in rows for k in r))
    if any(isinstance(v, (list, dict, tuple)) for r in rows for v in r.values()):
        raise ValueError("nested values are not supported")
    columns = {n: [r.get(n) for r in rows] for n in names}
    schema = T.StructType([T.StructField(n, _kind(v)) for n, v in columns.items()])
    cast = {f.name: {T.DoubleType: float, T.StringType: str}.get(type(f.dataType), lambda v: v) for f in schema}
    return spark.createDataFrame([tuple(None if r.get(n) is None else cast[n](r[n]) for n in names) for r in rows], schema)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema all columns are read as strings once, the strings for missing values
    become NULL, and types are inferred by aggregates over all rows."""
    options = {"header": True, "multiLine": False, "escape": '"'}
    if schema:
        return spark.read.csv(path, schema=schema, timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]", **options)
    raw = spark.read.csv(path, inferSchema=False, **options)
    raw = raw.select(*(F.when(col(c).isin(*MISSING), None).otherwise(col(c)).alias(c) for c in raw.columns))
    can = lambda c, kind: (col(c).isNull() | F.trim(col(c)).try_cast(kind).isNotNull()).cast("int")
    checks = {"bigint": lambda c: can(c, "bigint") * col(c).isNull().cast("int") + can(c, "bigint") * F.coalesce(F.trim(col(c)).rlike(r"^[+-]?[0-9]+$"), F.lit(False)).cast("int"), "double": lambda c: can(c, "double")}
    flags = raw.agg(*(F.min(check(c)).alias(f"{kind}{i}") for i, c in enumerate(raw.columns) for kind, check in checks.items()), *(F.min((col(c).isNull() | F.lower(col(c)).isin("true", "false")).cast("int")).alias(f"boolean{i}") for i, c in enumerate(raw.columns)), *(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(raw.columns))).first()
    out = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k in ("boolean", "bigint", "double") if flags[f"n{i}"] and flags[f"{k}{i}"]), "string")
        out.append((F.lower(col(c)) == "true" if kind == "boolean" else F.trim(col(c)).cast(kind) if kind != "string" else col(c)).alias(c))
    return raw.select(*out)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension, upper or lower case: .csv and .xlsx, else .parquet, .orc, .json. The binary .xls of old is refused."""
    kind = PurePosixPath(path).suffix.lower()
    try:
        if kind == ".csv":
            return read_csv(spark, path)
        if kind == ".xlsx":
            return read_excel(spark, path, MISSING)
        if kind == ".xls":
            raise ValueError("save the workbook as .xlsx")
        if kind in (".parquet", ".orc", ".json"):
            return spark.read.format(kind[1:]).load(path)
    except Exception as e:
        raise ValueError(f"Could not read uploaded file: {e}") from e
    raise ValueError("Upload a .csv, .xlsx, or .xls file.")


def sample_data(spark: SparkSession) -> DataFrame:
    """150 made-up flowers of three kinds: four measures and a target, for smoke tests."""
    i = F.col("id")
    kind = F.floor(i / 50).cast("int")
    wave = lambda n: (F.pmod(i * n, F.lit(11)) - 5) / 12
    measures = {"sepal length (cm)": (5.0, 0.8), "sepal width (cm)": (3.4, -0.25), "petal length (cm)": (1.5, 2.0), "petal width (cm)": (0.2, 0.9)}
    return spark.range(150).select(*(F.round(base + step * kind + wave(n + 3), 1).alias(c) for n, (c, (base, step)) in enumerate(measures.items())), kind.alias("target"))
