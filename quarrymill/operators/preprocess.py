"""Schema inference and the preprocessor: fitting is a few aggregates, transforming one projection.

The fitted state is plain data (JSON). Output columns, in this order: numeric ones (dates expand into numeric parts, which
come last among them), booleans, one-hot columns, ordinal codes. Only columns known at fit are read, in any order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DATE_PATTERN, DATE_PREFIX, as_datetime, boolean_code, col, date_parts, fill, normalize_missing, one_hot, ordinal, parse_datetime, scale
from . import stats

SAMPLE, SHARE = 25, 0.8
#: Dictionaries up to this size are part of the projection; larger ones are joined.
INLINE = 1000


@dataclass
class ColumnSchema:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)


def require_frame(df) -> DataFrame:
    if not hasattr(df, "queryExecution") and not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is expected")
    return df


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(all other columns, the target column)."""
    if target not in df.columns:
        raise ValueError(f"Target column {target!r} was not found in the dataset.")
    return df.drop(target), df.select(col(target))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return normalize_missing(df).where(col(target).isNotNull())


def date_shares(df: DataFrame, columns: Sequence[str], order_by: str | None = None) -> DataFrame:
    """(column, sampled, date_like, parsed) for string columns: shares among the first non-null values. order_by makes
    "first" independent of how the rows are stored; each column's sample is a top-k, so nothing is sorted whole."""
    parts = None
    for c in columns:
        part = df.where(col(c).isNotNull())
        part = (part.orderBy(col(order_by)) if order_by else part).limit(SAMPLE).select(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    hit = lambda x: F.avg(x.cast("int"))
    return parts.groupBy("column").agg(F.count(F.lit(1)).alias("sampled"), hit(F.col("value").rlike(DATE_PATTERN)).alias("date_like"), hit(parse_datetime(F.col("value")).isNotNull()).alias("parsed"))


def looks_like_datetime(df: DataFrame, column: str, order_by: str | None = None) -> bool:
    r = date_shares(df, [column], order_by).first()
    return bool(r) and r.date_like >= SHARE and r.parsed >= SHARE


def infer_schema(df: DataFrame, order_by: str | None = None) -> ColumnSchema:
    """Boolean, numeric, datetime, date-like string, else categorical. Booleans with missing values are categorical; columns
    without any value are ignored; intervals and nested columns are refused."""
    require_frame(df)
    out, strings, empty = ColumnSchema(), [], {}
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.BinaryType)):
            raise ValueError(f"column {f.name!r}: {f.dataType.simpleString()} columns are not supported")
    if df.columns:
        counts = normalize_missing(df).agg(F.count(F.lit(1)).alias("rows"), *(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
        empty = {c: counts[f"n{i}"] == 0 for i, c in enumerate(df.columns)}
        full = {c: counts[f"n{i}"] == counts["rows"] for i, c in enumerate(df.columns)}
    for f in df.schema:
        if empty[f.name]:
            out.ignored.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            (out.boolean if full[f.name] else out.categorical).append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out.numeric.append(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.datetime.append(f.name)
        else:
            strings.append(f.name)
    if strings:
        dates = {r.column for r in date_shares(df, strings, order_by).collect() if r.date_like >= SHARE and r.parsed >= SHARE}
        for c in strings:
            (out.datetime if c in dates else out.categorical).append(c)
        out.categorical.sort(key=df.columns.index)
        out.datetime.sort(key=df.columns.index)
    return out


def category(name: str, kind: T.DataType) -> Column:
    """A categorical value as a string; booleans are spelt True and False."""
    if isinstance(kind, T.BooleanType):
        return F.when(col(name), "True").when(~col(name), "False")
    return col(name).cast("string")


class AutoPreprocessor:
    def __init__(
        self,
        encoding: str = "onehot",
        scaling: str = "standard",
        datetime_features: bool = True,
        max_onehot_cardinality: int = 50,
        numeric_impute_strategy: str = "median",
        categorical_impute_strategy: str = "most_frequent",
        order_by: str | None = None,
    ):
        for value, allowed in ((encoding, ("onehot", "ordinal")), (scaling, ("standard", "none")), (numeric_impute_strategy, ("median", "mean", "most_frequent", "constant")), (categorical_impute_strategy, ("most_frequent", "constant"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
        self.encoding, self.scaling, self.datetime_features = encoding, scaling, datetime_features
        self.max_onehot_cardinality, self.order_by = max_onehot_cardinality, order_by
        self.numeric_impute_strategy, self.categorical_impute_strategy = numeric_impute_strategy, categorical_impute_strategy
        self.state: dict | None = None
        self.dictionaries: dict[str, DataFrame] = {}

    def _numeric(self, df: DataFrame, schema: ColumnSchema) -> dict[str, Column]:
        kinds = {f.name: f.dataType for f in df.schema}
        found = {c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) if c in kinds else None for c in schema.numeric}
        if self.datetime_features:
            for c in schema.datetime:
                found |= date_parts(c, as_datetime(col(c), kinds[c]))
        return found

    def fit(self, df: DataFrame, target: str | None = None) -> AutoPreprocessor:
        """target: a column to leave out."""
        features = require_frame(df).drop(target) if target else require_frame(df)
        if clash := [c for c in features.columns if c.startswith(DATE_PREFIX)]:
            raise ValueError(f"column names that begin with {DATE_PREFIX} are reserved: {clash}")
        features = normalize_missing(features)
        schema = infer_schema(features, self.order_by)
        kinds = {f.name: f.dataType for f in features.schema}
        numeric = self._numeric(features, schema)

        if self.numeric_impute_strategy == "median":
            surrogate = stats.medians(features, numeric)
        elif self.numeric_impute_strategy == "mean":
            surrogate = {k: m for k, (m, _) in stats.moments(features, numeric).items()}
        elif self.numeric_impute_strategy == "constant":
            surrogate = dict.fromkeys(numeric, 0.0)
        else:
            plain = features.select(*(v.alias(k) for k, v in numeric.items()))
            got = plain.agg(*(F.mode(col(k), True).alias(f"m{i}") for i, k in enumerate(numeric))).first() if numeric else []
            surrogate = dict(zip(numeric, got, strict=True))
        numeric = {k: v for k, v in numeric.items() if surrogate[k] is not None}
        centre = stats.moments(features, {k: fill(v, surrogate[k]) for k, v in numeric.items()}) if self.scaling == "standard" else {}

        # Booleans and categories share one histogram.
        discrete = [*schema.boolean, *schema.categorical]
        counts, summary, values = None, {}, {}
        if discrete:
            named = features.select(*(category(c, kinds[c]).alias(c) for c in discrete))
            counts = stats.histogram(named, discrete).persist()
            summary = stats.modes(counts)
            short = [c for c in discrete if summary[c][0] <= max(INLINE, self.max_onehot_cardinality)]
            for r in counts.where(F.col("column").isin(short)).select("column", "value").collect():
                values.setdefault(r["column"], []).append(r["value"])
        constant = self.categorical_impute_strategy == "constant"
        modes = {c: ("missing_value" if constant and c in schema.categorical else summary[c][1]) for c in discrete}
        if constant:
            missing = features.agg(*(F.count(F.when(col(c).isNull(), 1)).alias(c) for c in schema.categorical)).first() if schema.categorical else {}
            for c in schema.categorical:
                if missing[c] and c in values:
                    values[c] = list({*values[c], "missing_value"})
        low = [c for c in schema.categorical if summary[c][0] <= self.max_onehot_cardinality] if self.encoding == "onehot" else []
        high = [c for c in schema.categorical if c not in low]
        self.state = {
            "schema": asdict(schema),
            "numeric": [[k, surrogate[k], *centre.get(k, (0.0, 1.0))] for k in numeric],
            "boolean": [[c, modes[c] == "True", sorted(v == "True" for v in values[c])] for c in schema.boolean],
            "onehot": [[c, modes[c], sorted(values[c], key=str.encode)] for c in low],
            "ordinal": [[c, modes[c], sorted(values[c], key=str.encode) if c in values else None] for c in high],
            "dates": {c: kinds[c].simpleString() for c in schema.datetime} if self.datetime_features else {},
        }
        self.dictionaries = {c: _ranked(counts.where(F.col("column") == c).select("value")) for c, _, known in self.state["ordinal"] if known is None}
        if counts is not None and not self.dictionaries:
            counts.unpersist()
        names = self.get_feature_names_out()
        if len(set(names)) < len(names):
            raise ValueError(f"feature names are not unique: {sorted({n for n in names if names.count(n) > 1})}")
        return self

    def _check_is_fitted(self) -> dict:
        if self.state is None:
            raise RuntimeError("AutoPreprocessor must be fitted before transform().")
        return self.state

    def get_feature_names_out(self) -> list[str]:
        s = self._check_is_fitted()
        return [*(r[0] for r in s["numeric"]), *(r[0] for r in s["boolean"]), *(f"{c}_{k}" for c, _, known in s["onehot"] for k in known), *(r[0] for r in s["ordinal"])]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The feature columns, after the columns `keep` of df as they are. Also runs on a stream, unless a dictionary of
        more than INLINE values has to be joined."""
        s = self._check_is_fitted()
        schema = ColumnSchema(**s["schema"])
        needed = [*(c for c in schema.numeric if any(r[0] == c for r in s["numeric"])), *s["dates"], *(r[0] for k in ("boolean", "onehot", "ordinal") for r in s[k])]
        if lost := [c for c in needed if c not in df.columns]:
            raise ValueError(f"columns are missing: {lost}")
        kinds = {f.name: f.dataType for f in df.schema}
        numeric = {c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) for c in schema.numeric if c in needed}
        for c in s["dates"]:
            numeric |= date_parts(c, as_datetime(col(c), kinds[c]))
        out = [col(c) for c in keep]
        for k, surrogate, mean, deviation in s["numeric"]:
            value = fill(numeric[k], surrogate)
            out.append((scale(value, mean, deviation) if self.scaling == "standard" else value).alias(k))
        for c, mode, seen in s["boolean"]:
            out.append(boolean_code(fill(col(c), mode), seen, c).alias(c))
        for c, mode, known in s["onehot"]:
            value = fill(category(c, kinds[c]), mode)
            out += [one_hot(value, k).alias(f"{c}_{k}") for k in known]
        for i, (c, mode, known) in enumerate(s["ordinal"]):
            value = fill(category(c, kinds[c]), mode)
            if known is None:  # a large dictionary: a join, which Spark broadcasts if its size allows
                table = self.dictionaries[c].select(F.col("value").alias(f"__key_{i}"), F.col("code").alias(f"__code_{i}"))
                df = df.withColumn(f"__value_{i}", value).join(table, F.col(f"__value_{i}") == F.col(f"__key_{i}"), "left")
                out.append(F.coalesce(F.col(f"__code_{i}").cast("double"), F.lit(-1.0)).alias(c))
            else:
                out.append(ordinal(value, known).alias(c))
        return df.select(*out)

    def fit_transform(self, df: DataFrame, target: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, target).transform(df, keep)

    def to_json(self) -> str:
        params = {k: getattr(self, k) for k in ("encoding", "scaling", "datetime_features", "max_onehot_cardinality", "numeric_impute_strategy", "categorical_impute_strategy", "order_by")}
        return json.dumps({"params": params, "state": self._check_is_fitted()})

    @classmethod
    def from_json(cls, text: str, dictionaries: dict[str, DataFrame] | None = None) -> AutoPreprocessor:
        data = json.loads(text)
        made = cls(**data["params"])
        made.state, made.dictionaries = data["state"], dictionaries or {}
        return made


def _ranked(values: DataFrame) -> DataFrame:
    """(value, code): places in sorted order, without one task that holds all values: ranges are counted, each value's
    place is its place in its range plus the ranges before."""
    ordered = values.distinct().repartitionByRange("value").sortWithinPartitions("value")
    ordered = ordered.select("value", F.spark_partition_id().alias("part")).persist()
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    table = F.map_from_arrays(F.array(*(F.lit(p) for p, _ in offsets)), F.array(*(F.lit(o) for _, o in offsets))) if offsets else F.create_map()
    return ordered.select("value", (F.element_at(table, F.col("part")) + place).cast("long").alias("code"))
