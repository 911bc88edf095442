"""Task detection, hold-out split and folds: exact sizes, deterministic, classes kept in proportion.

Rows are ordered by md5 of seed and key, so which rows fall where depends on neither storage nor partitions. Quotas are
worked out from the class histogram. Ranks inside a class are counted in RANGES ranges of the hash: a range's rows are
ranked on their own and the sizes of the ranges before are added, so a class that holds most rows is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, lookup

RANGES = 256


def detect_task_type(df: DataFrame, target: str) -> str:
    """Classification for other than numbers, at most 20 distinct values, or one distinct value per 20 rows."""
    y = col(target)
    kind = df.schema[target].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        y = F.nanvl(y, F.lit(None).cast(kind))
    n, distinct = df.agg(F.count(y), F.countDistinct(y)).first()
    if not n:
        raise ValueError("Cannot infer task type from an empty target column.")
    if not isinstance(kind, T.NumericType):
        return "classification"
    return "classification" if distinct <= 20 or distinct / n <= 0.05 else "regression"


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def ranked(df: DataFrame, key: str, seed: int, by: str | None) -> DataFrame:
    """df with `__rank`: the place from 0 of each row in its class, in order of the hash."""
    stratum = col(by) if by else F.lit(0)
    rows = df.withColumn("__hash", order_key(key, seed)).withColumn("__range", F.conv(F.substring("__hash", 1, 2), 16, 10).cast("int")).withColumn("__stratum", stratum)
    sizes = rows.groupBy("__stratum", "__range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("__stratum").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__stratum").alias("__s"), F.col("__range").alias("__r"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__stratum", "__range").orderBy("__hash", col(key))) - 1
    rows = rows.withColumn("__place", place).join(offsets, F.col("__stratum").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    return rows.withColumn("__rank", F.col("__place") + F.col("__before")).drop("__hash", "__range", "__s", "__r", "__before", "__place")


def class_quotas(counts: dict, share: float) -> dict:
    """Rows of each class in the test part: floors of the exact shares, the rest to the largest remainders (then to the
    smaller class names); ceil(share * all rows) in total."""
    total = math.ceil(share * sum(counts.values()))
    exact = {k: total * n / sum(counts.values()) for k, n in counts.items()}
    quota = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(counts, key=lambda k: (-(exact[k] - quota[k]), k))[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def holdout(df: DataFrame, key: str, target: str | None = None, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test. target: keep its classes in proportion; every class needs two rows."""
    if target:
        counts = {r[0]: r[1] for r in df.groupBy(col(target)).count().collect()}
        if len(counts) > 1 and min(counts.values()) < 2:
            raise ValueError("a class with a single row can't be split")
        quota = class_quotas(counts, test_size)
        limit = lookup(F.col("__stratum"), quota, 0)
    else:
        limit = F.lit(math.ceil(test_size * df.count()))
    return ranked(df, key, seed, target).withColumn("is_test", F.col("__rank") < limit).drop("__rank", "__stratum")


def fold_count(df: DataFrame, target: str, folds: int = 5) -> int:
    """At least two, at most the size of the smallest class."""
    least = df.groupBy(col(target)).count().agg(F.min("count")).first()[0]
    return max(2, min(folds, least or 0))


def assign_folds(df: DataFrame, key: str, folds: int, target: str | None = None, seed: int = 42) -> DataFrame:
    """df with fold: the rows of each class are dealt out in turn."""
    return ranked(df, key, seed, target).withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__rank", "__stratum")
