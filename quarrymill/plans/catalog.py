"""The driver's queries over the engine's own operators, and their SQL. Missing values are put in where the tables have
none, in the same way on both sides; floating-point results are rounded on both sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, date_parts, flatten_params, normalize_missing, parse_datetime
from ..operators import metrics as M
from ..operators import models
from ..operators.automl import profile, run_automl
from ..operators.features import AutoFeatureEngineer, array_features
from ..operators.preprocess import AutoPreprocessor, date_shares, drop_missing_target, infer_schema, split_features_target
from ..operators.registry import latest_version, resolve_uri, version_by_run
from ..operators.scratch import fresh
from ..operators.search import HPOEngine, RandomSampler, trials_frame
from ..operators.split import assign_folds, detect_task_type, fold_count, holdout
from ..operators.trees import feature_cuts
from ..sources import excel
from ..sources.readers import MISSING, from_rows, read_csv
from ..streaming.scoring import transform_stream, write_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(col(c), digits).alias(c) if k == "double" else col(c) for c, k in df.dtypes))


def holes(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % every == 0, None).otherwise(F.col(column)))


# Sources, projections, filters


@query("SELECT * EXCLUDE (l_extendedprice) FROM lineitem")
def features_of_split(spark, sf):
    return split_features_target(table(spark, sf, "lineitem"), "l_extendedprice")[0]


@query("SELECT l_extendedprice FROM lineitem")
def target_of_split(spark, sf):
    return split_features_target(table(spark, sf, "lineitem"), "l_extendedprice")[1]


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0")
def drop_missing_target_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    nan = F.when(F.col("l_orderkey") % 14 == 0, float("nan")).when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_quantity"))
    return drop_missing_target(rows.withColumn("l_quantity", nan), "l_quantity")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id % 10 <> 0) AS n_values, round(avg(value) FILTER (WHERE event_id % 10 <> 0), 6) AS mean_value FROM events")
def normalize_missing_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")))
    return normalize_missing(rows).agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_scan(spark, sf):
    events, path = table(spark, sf, "events"), fresh(spark, "events-csv")
    events.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True, escape='"')
    found = read_csv(spark, path)
    return found.withColumn("ts", F.to_timestamp_ntz("ts"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def rows_scan(spark, sf):
    rows = from_rows(spark, [r.asDict() for r in table(spark, sf, "nation").collect()])  # 25 rows, as a request holds them
    return rows.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE orders)) AS n_columns FROM orders")
def dataset_profile(spark, sf):
    return spark.createDataFrame([profile(table(spark, sf, "orders"))])


# Schema


def _kinds(spark, **frames) -> DataFrame:
    rows = []
    for name, (df, key) in frames.items():
        s = infer_schema(df, key)
        rows += [(name, c, kind) for kind in ("numeric", "categorical", "datetime", "boolean", "ignored") for c in getattr(s, kind)]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


@query("""
SELECT * FROM (VALUES
  ('orders', 'o_orderkey', 'numeric'), ('orders', 'o_custkey', 'numeric'), ('orders', 'o_orderstatus', 'categorical'), ('orders', 'o_totalprice', 'numeric'),
  ('orders', 'o_orderdate', 'datetime'), ('orders', 'o_orderpriority', 'categorical'), ('orders', 'slashed', 'datetime'), ('orders', 'big', 'boolean'),
  ('orders', 'big_or_missing', 'categorical'), ('orders', 'nothing', 'ignored'),
  ('events', 'event_id', 'numeric'), ('events', 'ts', 'datetime'), ('events', 'user_id', 'numeric'), ('events', 'event_type', 'categorical'), ('events', 'value', 'numeric'), ('events', 'props', 'categorical'),
  ('part', 'p_partkey', 'numeric'), ('part', 'p_name', 'categorical'), ('part', 'p_brand', 'categorical'), ('part', 'p_type', 'categorical'), ('part', 'p_size', 'numeric'), ('part', 'p_retailprice', 'numeric')
) AS t(table_name, column_name, kind)
""")
def schema_inference(spark, sf):
    big = F.col("o_totalprice") > 100000
    orders = table(spark, sf, "orders").withColumns({
        "slashed": F.date_format("o_orderdate", "yyyy/MM/dd"), "big": big, "big_or_missing": F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(big), "nothing": F.lit(None).cast("string"),
    })
    return _kinds(spark, orders=(orders, "o_orderkey"), events=(table(spark, sf, "events"), "event_id"), part=(table(spark, sf, "part"), "p_partkey"))


@query(r"""
WITH s AS (
  (SELECT 'date_text' AS column_name, CAST(o_orderdate AS VARCHAR) AS v FROM orders ORDER BY o_orderkey LIMIT 25) UNION ALL
  (SELECT 'mixed', CASE WHEN o_orderkey % 4 = 0 THEN 'n/k' ELSE CAST(o_orderdate AS VARCHAR) END FROM orders ORDER BY o_orderkey LIMIT 25) UNION ALL
  (SELECT 'status', o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25)
)
SELECT column_name, count(*) AS sampled, avg(CAST(regexp_matches(v, '\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}') AS INT)) AS date_like,
       avg(CAST(try_cast(v AS TIMESTAMP) IS NOT NULL AS INT)) AS parsed
FROM s GROUP BY column_name
""")
def looks_like_datetime(spark, sf):
    text = F.col("o_orderdate").cast("string")
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("date_text"), F.when(F.col("o_orderkey") % 4 == 0, "n/k").otherwise(text).alias("mixed"), F.col("o_orderstatus").alias("status"))
    return date_shares(rows, ["date_text", "mixed", "status"], "o_orderkey").withColumnRenamed("column", "column_name")


# Preprocessing


def _imputed(spark, sf, strategy) -> DataFrame:
    rows = holes(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_quantity", "l_orderkey", 7)
    made = AutoPreprocessor(scaling="none", numeric_impute_strategy=strategy).fit(rows.select("l_quantity"))
    return rounded(made.transform(rows, keep=["l_orderkey", "l_linenumber"]))


_IMPUTE = "SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END, (SELECT {} FROM lineitem WHERE l_orderkey % 7 <> 0)), 6) AS l_quantity FROM lineitem"


@query(_IMPUTE.format("median(l_quantity)"))
def impute_median(spark, sf):
    return _imputed(spark, sf, "median")


@query(_IMPUTE.format("avg(l_quantity)"))
def impute_mean(spark, sf):
    return _imputed(spark, sf, "mean")


@query(_IMPUTE.replace("(SELECT {} FROM lineitem WHERE l_orderkey % 7 <> 0)", "0.0"))
def impute_constant(spark, sf):
    return _imputed(spark, sf, "constant")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders),
m AS (SELECT v FROM o WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1),
f AS (SELECT o_orderkey, coalesce(v, (SELECT v FROM m)) AS v FROM o),
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM f))
SELECT o_orderkey, CAST(code AS DOUBLE) AS o_orderpriority FROM f JOIN d USING (v)
""")
def impute_mode(spark, sf):
    rows = holes(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5)
    return AutoPreprocessor(encoding="ordinal").fit(rows.select("o_orderpriority")).transform(rows, keep=["o_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice, CAST(0 AS DOUBLE) AS constant
FROM lineitem
""")
def standard_scale(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(3).alias("constant"))
    made = AutoPreprocessor().fit(rows.drop("l_orderkey", "l_linenumber"))
    return rounded(made.transform(rows, keep=["l_orderkey", "l_linenumber"])).withColumn("constant", F.col("constant") + 0.0)


_PARTS = "CAST(year({0}) AS DOUBLE) AS __dt_{0}_year, CAST(month({0}) AS DOUBLE) AS __dt_{0}_month, CAST(day({0}) AS DOUBLE) AS __dt_{0}_day, CAST(isodow({0}) - 1 AS DOUBLE) AS __dt_{0}_dayofweek, CAST(hour({0}) AS DOUBLE) AS __dt_{0}_hour"


@query(f"SELECT event_id, {_PARTS.format('ts')} FROM events")
def datetime_expand(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return AutoPreprocessor(scaling="none").fit(rows.select("ts")).transform(rows, keep=["event_id"])


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_ONE_HOT = "CAST(c_mktsegment = '{0}' AS DOUBLE) AS \"c_mktsegment_{0}\""


@query(f"SELECT c_custkey, {', '.join(map(_ONE_HOT.format, _SEGMENTS))} FROM customer")
def onehot_encode(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return AutoPreprocessor().fit(rows.select("c_mktsegment")).transform(rows, keep=["c_custkey"])


@query(f"SELECT c_custkey, {', '.join(_ONE_HOT.format(s) for s in _SEGMENTS if s != 'BUILDING')} FROM customer")
def onehot_unknown(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return AutoPreprocessor().fit(rows.where("c_mktsegment <> 'BUILDING'").select("c_mktsegment")).transform(rows, keep=["c_custkey"])


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS DOUBLE) AS p_name FROM part")
def ordinal_encode(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return AutoPreprocessor(max_onehot_cardinality=5).fit(rows.select("p_name")).transform(rows, keep=["p_partkey"])


@query("""
WITH d AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 10))
SELECT p_partkey, CAST(coalesce(code, -1) AS DOUBLE) AS p_name FROM part LEFT JOIN d USING (p_name)
""")
def ordinal_unknown(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return AutoPreprocessor(encoding="ordinal").fit(rows.where("p_size <= 10").select("p_name")).transform(rows, keep=["p_partkey"])


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS c_name FROM customer")
def ordinal_large_dictionary(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return AutoPreprocessor().fit(rows.select("c_name")).transform(rows, keep=["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS DOUBLE) AS many, CAST(0 AS DOUBLE) AS always FROM lineitem")
def boolean_encode(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("many"), F.lit(True).alias("always"))
    return AutoPreprocessor().fit(rows.select("many", "always")).transform(rows, keep=["l_orderkey", "l_linenumber"])


@query("""
SELECT column_name, n_distinct, CASE WHEN n_distinct <= 50 THEN 'onehot' ELSE 'ordinal' END AS encoding FROM (
  SELECT 'p_name' AS column_name, count(DISTINCT p_name) AS n_distinct FROM part UNION ALL
  SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)
""")
def cardinality_split(spark, sf):
    made = AutoPreprocessor().fit(table(spark, sf, "part").select("p_name", "p_brand", "p_type"))
    size = lambda c, known: made.dictionaries[c].count() if known is None else len(known)
    rows = [(c, size(c, known), kind) for kind in ("onehot", "ordinal") for c, _, known in made.state[kind]]
    return spark.createDataFrame(rows, "column_name string, n_distinct long, encoding string")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _z(name: str, value: str) -> str:
    return f'round(coalesce(({value} - avg({value}) OVER ()) / nullif(stddev_pop({value}) OVER (), 0), 0), 6) AS "{name}"'


@query(f"""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders), f AS (SELECT *, coalesce(p, (SELECT median(p) FROM o)) AS price FROM o)
SELECT o_orderkey, o_orderstatus, {_z('o_totalprice', 'price')}, {_z('__dt_o_orderdate_year', 'year(o_orderdate)')}, {_z('__dt_o_orderdate_month', 'month(o_orderdate)')},
       {_z('__dt_o_orderdate_day', 'day(o_orderdate)')}, {_z('__dt_o_orderdate_dayofweek', '(isodow(o_orderdate) - 1)')}, {_z('__dt_o_orderdate_hour', 'hour(o_orderdate)')},
       CAST(o_totalprice > 100000 AS DOUBLE) AS big, {', '.join(f"CAST(o_orderpriority = '{p}' AS DOUBLE) AS {chr(34)}o_orderpriority_{p}{chr(34)}" for p in _PRIORITIES)}
FROM f
""")
def full_preprocess(spark, sf):
    orders = table(spark, sf, "orders").withColumn("big", F.col("o_totalprice") > 100000)
    orders = holes(orders, "o_totalprice", "o_orderkey", 7)
    made = AutoPreprocessor().fit(orders.drop("o_orderkey", "o_custkey"), "o_orderstatus")
    return rounded(made.transform(orders, keep=["o_orderkey", "o_orderstatus"]))


# Features


@query(f"""
SELECT feature, round(v, 6) AS variance, v > 0.16 AS kept FROM (
  {' UNION ALL '.join(f"SELECT 'c_mktsegment_{s}' AS feature, var_pop(CAST(c_mktsegment = '{s}' AS DOUBLE)) AS v FROM customer" for s in _SEGMENTS)} UNION ALL
  SELECT 'rare', var_pop(CAST(c_custkey % 120 = 0 AS DOUBLE)) FROM customer)
""")
def variance_filter(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment", (F.col("c_custkey") % 120 == 0).cast("double").alias("rare"))
    features = AutoPreprocessor(scaling="none").fit_transform(rows)
    kept = AutoFeatureEngineer(variance_threshold=0.16).fit(features).selected_original_features()
    spread = features.agg(*(F.var_pop(col(c)).alias(c) for c in features.columns)).unpivot([], features.columns, "feature", "v")
    return spread.select("feature", F.round("v", 6).alias("variance"), F.col("feature").isin(kept).alias("kept"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(1 AS DOUBLE) AS "1", l_quantity, l_discount, round(l_quantity * l_quantity, 6) AS "l_quantity^2",
       round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_discount * l_discount, 6) AS "l_discount^2" FROM lineitem
""")
def polynomial_degree2(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    made = AutoFeatureEngineer(polynomial_degree=2, polynomial_include_bias=True).fit(rows, features=["l_quantity", "l_discount"])
    return rounded(made.transform(rows, keep=["l_orderkey", "l_linenumber"]))


@query(f"SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i}' for i in range(64))} FROM embeddings")
def matrix_features(spark, sf):
    return array_features(table(spark, sf, "embeddings"), "embedding", keep=["vec_id"])


@query()
def pca_project(spark, sf):
    rows = array_features(table(spark, sf, "embeddings"), "embedding", keep=["vec_id"])
    names = [c for c in rows.columns if c != "vec_id"]
    return AutoFeatureEngineer(use_pca=True, pca_n_components=8).fit(rows, features=names).transform(rows, keep=["vec_id"])


def _order_features(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    made = AutoPreprocessor().fit(orders.drop("o_orderkey", "o_custkey"), "o_orderstatus")
    return made.transform(orders, keep=["o_orderkey", "o_orderstatus"])


@query()
def rfe_select(spark, sf):
    rows = _order_features(spark, sf)
    rows = rows.withColumn("y", models.Labels.of(rows, "o_orderstatus").encode(F.col("o_orderstatus"))).drop("o_orderkey", "o_orderstatus")
    from pyspark.ml.classification import RandomForestClassifier

    made = AutoFeatureEngineer(use_rfe=True, rfe_n_features=0.7, rfe_estimator=RandomForestClassifier(numTrees=10, seed=42)).fit(rows, "y")
    return spark.createDataFrame([(n,) for n in made.get_feature_names_out()], "feature string")


_FORMS = ["MMMM d, yyyy h:mm a", "d MMM yyyy HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss '+0100'", "yyyy-MM-dd hh:mm:ss a", "MMM-dd-yyyy 'at' h:mma", "yyyy/MM/dd'T'HH:mm:ss.SSS'Z'", "yyyyMMdd HH:mm", "EEEE, MMMM d yyyy 'UTC'"]


@query(f"""
WITH w AS (SELECT o_orderkey, o_orderkey % {len(_FORMS)} AS form, o_orderdate + to_minutes(o_orderkey * 7 % 1440) AS t FROM orders)
SELECT o_orderkey, CAST(year(t) AS DOUBLE) AS year, CAST(month(t) AS DOUBLE) AS month, CAST(day(t) AS DOUBLE) AS day, CAST(isodow(t) - 1 AS DOUBLE) AS dayofweek,
  CASE WHEN form = {len(_FORMS) - 1} THEN 0.0 ELSE CAST(hour(t) AS DOUBLE) END AS hour FROM w
""")
def written_dates(spark, sf):
    """The parts of dates that are written in eight forms, each row in one."""
    orders = table(spark, sf, "orders")
    t = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=(F.col("o_orderkey") * 7 % 1440).cast("int"))
    form = F.col("o_orderkey") % len(_FORMS)
    text = F.coalesce(*(F.when(form == i, F.date_format(t, f)) for i, f in enumerate(_FORMS)))
    parts = date_parts("d", parse_datetime(F.col("text")))
    return orders.select("o_orderkey", text.alias("text")).select("o_orderkey", *(v.alias(k.removeprefix("__dt_d_")) for k, v in parts.items()))


# Splits


@query("""
SELECT target, CASE WHEN NOT is_number OR d <= 20 OR d / n <= 0.05 THEN 'classification' ELSE 'regression' END AS task FROM (
  SELECT 'orders.o_orderstatus' AS target, false AS is_number, count(DISTINCT o_orderstatus) AS d, CAST(count(*) AS DOUBLE) AS n FROM orders UNION ALL
  SELECT 'orders.o_totalprice', true, count(DISTINCT o_totalprice), count(*) FROM orders UNION ALL
  SELECT 'lineitem.l_linenumber', true, count(DISTINCT l_linenumber), count(*) FROM lineitem UNION ALL
  SELECT 'part.p_size', true, count(DISTINCT p_size), count(*) FROM part UNION ALL
  SELECT 'embeddings.label', true, count(DISTINCT label), count(*) FROM embeddings)
""")
def task_types(spark, sf):
    targets = ("orders.o_orderstatus", "orders.o_totalprice", "lineitem.l_linenumber", "part.p_size", "embeddings.label")
    return spark.createDataFrame([(t, detect_task_type(table(spark, sf, t.split(".")[0]), t.split(".")[1])) for t in targets], "target string, task string")


@query("""
WITH c AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT sum(n) AS a, ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS t FROM c),
e AS (SELECT y, t * n / a AS exact, floor(t * n / a) AS low, t FROM c, s),
q AS (SELECT y, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, y) <= t - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS place FROM orders)
SELECT o_orderkey, o_orderstatus, place <= quota AS is_test FROM r JOIN q ON r.o_orderstatus = q.y
""")
def holdout_split(spark, sf):
    return holdout(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM orders
""")
def holdout_regression(spark, sf):
    return holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def cv_folds(spark, sf):
    return assign_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, "o_orderstatus")


@query("SELECT CAST(greatest(2, least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)))) AS BIGINT) AS folds, CAST(greatest(2, least(500, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)))) AS BIGINT) AS folds_of_500")
def min_class_folds(spark, sf):
    labels = table(spark, sf, "labels")
    return spark.createDataFrame([(fold_count(labels, "quality"), fold_count(labels, "quality", 500))], "folds long, folds_of_500 long")


@query("SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS BIGINT) AS code, l_linenumber AS label FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def label_dictionary(spark, sf):
    found = models.Labels.of(table(spark, sf, "lineitem"), "l_linenumber").values
    return spark.createDataFrame(list(enumerate(found)), "code long, label int")


# Metrics

_RULE = "SELECT o_orderkey, o_orderstatus AS y, CASE WHEN o_totalprice < 120000 THEN 'F' WHEN o_totalprice < 250000 THEN 'O' ELSE 'P' END AS p, o_totalprice AS score FROM orders"


def _rule(spark, sf) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("y"), F.when(price < 120000, "F").when(price < 250000, "O").otherwise("P").alias("p"), price.alias("score"))


@query(f"WITH r AS ({_RULE}), l AS (SELECT y AS k FROM r UNION SELECT p FROM r) SELECT a.k AS y, b.k AS p, count(r.o_orderkey) AS n FROM l a CROSS JOIN l b LEFT JOIN r ON r.y = a.k AND r.p = b.k GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_rule(spark, sf))


@query(f"""
WITH r AS ({_RULE}), l AS (SELECT y AS k FROM r UNION SELECT p FROM r),
c AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS d, count(*) FILTER (WHERE y = k AND p = k) AS h FROM l, r GROUP BY k)
SELECT round(sum(h) / CAST(sum(s) AS DOUBLE), 6) AS test_accuracy, round(sum(coalesce(h / nullif(CAST(d AS DOUBLE), 0), 0) * s) / sum(s), 6) AS test_precision,
       round(sum(coalesce(h / nullif(CAST(s AS DOUBLE), 0), 0) * s) / sum(s), 6) AS test_recall, round(sum(coalesce(2 * h / nullif(CAST(d + s AS DOUBLE), 0), 0) * s) / sum(s), 6) AS test_f1 FROM c
""")
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(_rule(spark, sf)))


_AUC = "(sum(CASE WHEN {0} THEN r ELSE 0 END) - count(*) FILTER (WHERE {0}) * (count(*) FILTER (WHERE {0}) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE {0}) AS DOUBLE) * count(*) FILTER (WHERE NOT ({0})))"


@query(f"WITH s AS (SELECT quality, round(ln(n_chars + 1), 1) AS score FROM labels JOIN documents USING (doc_id)), k AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round({_AUC.format('quality = 1')}, 6) AS test_roc_auc FROM k")
def roc_auc_binary(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(M.roc_auc(rows.select(F.col("quality").alias("y"), F.round(F.log(F.col("n_chars") + 1), 1).alias("score")), 1))


@query(f"""
WITH s AS ({_RULE}), k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
a AS ({' UNION ALL '.join(f"SELECT {_AUC.format(f"y = '{c}'")} AS auc, count(*) FILTER (WHERE y = '{c}') AS n FROM k" for c in 'FOP')})
SELECT round(sum(auc * n) / sum(n), 6) AS roc_auc_ovr_weighted FROM a
""")
def roc_auc_ovr_weighted(spark, sf):
    rows = _rule(spark, sf).select("y", F.array("score", "score", "score").alias("scores"))
    return rounded(M.roc_auc_ovr_weighted(rows, ["F", "O", "P"]))


@query("""
WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS test_rmse, round(avg(abs(y - p)), 4) AS test_mae, round(1 - sum((y - p) * (y - p)) / (SELECT sum((y - (SELECT avg(y) FROM r)) * (y - (SELECT avg(y) FROM r))) FROM r), 6) AS test_r2 FROM r
""")
def regression_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    return M.regression_metrics(rows).select(F.round("test_rmse", 4).alias("test_rmse"), F.round("test_mae", 4).alias("test_mae"), F.round("test_r2", 6).alias("test_r2"))


@query("""
WITH s AS (SELECT l_linenumber AS trial_number, l_suppkey % 5 AS fold, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2)
SELECT trial_number, round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std FROM s GROUP BY 1
""")
def cv_summary(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("trial_number"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("score"))
    return rounded(M.cv_summary(scores))


_TRIALS = "SELECT CAST(s_suppkey AS INT) AS trial_number, CASE s_suppkey % 3 WHEN 0 THEN 'random_forest' WHEN 1 THEN 'xgboost' ELSE 'lightgbm' END AS model_family, round(s_acctbal / 2000) / 5 AS cv_score FROM supplier"


def _trials(spark, sf) -> DataFrame:
    n = F.col("s_suppkey") % 3
    family = F.when(n == 0, "random_forest").when(n == 1, "xgboost").otherwise("lightgbm")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("trial_number"), family.alias("model_family"), (F.round(F.col("s_acctbal") / 2000) / 5).alias("cv_score"))


@query(f"SELECT * FROM ({_TRIALS}) ORDER BY cv_score DESC, trial_number LIMIT 10")
def trial_leaderboard(spark, sf):
    return M.leaderboard(_trials(spark, sf), 10)


@query(f"SELECT * FROM ({_TRIALS}) ORDER BY cv_score DESC, trial_number LIMIT 1")
def best_trial(spark, sf):
    return M.best_trial(_trials(spark, sf))


@query("SELECT p_name AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def importance_topk(spark, sf):
    return M.top_importances(table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("importance")))


@query("SELECT key, value FROM (SELECT event_id AS key, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'NaN'::DOUBLE WHEN event_id % 8 = 2 THEN 'Infinity'::DOUBLE ELSE value END AS value FROM events) WHERE isfinite(value)")
def metric_finite_filter(spark, sf):
    n = F.col("event_id")
    value = F.when(n % 4 == 0, None).when(n % 4 == 1, math.nan).when(n % 8 == 2, math.inf).otherwise(F.col("value"))
    return M.finite(table(spark, sf, "events").select(n.alias("key"), value.alias("value")))


@query("""
WITH g AS (SELECT o_orderpriority AS name, count(*) AS n, min(o_orderstatus) AS first, CASE WHEN count(*) % 2 = 0 THEN NULL ELSE max(o_custkey) END AS odd, count(*) > 300 AS many FROM orders GROUP BY 1)
SELECT name, 'n' AS key, CAST(n AS VARCHAR) AS value FROM g UNION ALL SELECT name, 'first', first FROM g UNION ALL
SELECT name, 'odd', coalesce(CAST(odd AS VARCHAR), 'None') FROM g UNION ALL SELECT name, 'many', CASE WHEN many THEN 'True' ELSE 'False' END FROM g
""")
def param_flatten(spark, sf):
    """Each priority's figures as the parameters of a run: numbers, strings, booleans and missing values."""
    n = F.count(F.lit(1))
    found = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(n.alias("n"), F.min("o_orderstatus").alias("first"), F.when(n % 2 != 0, F.max("o_custkey")).alias("odd"), (n > 300).alias("many"))
    rows = [(r.name, k, v) for r in found.collect() for k, v in flatten_params({c: r[c] for c in ("n", "first", "odd", "many")}).items()]  # a row a priority
    return spark.createDataFrame(rows, "name string, key string, value string")


# Registry

_VERSIONS = "SELECT o_orderpriority AS name, CAST(o_orderkey AS INT) AS version, CAST(o_custkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS DOUBLE) END AS created FROM orders"
_NEWEST = "SELECT name, arg_max(version, (coalesce(created, 0), version)) AS v FROM ({}) GROUP BY name"


def _versions(spark, sf) -> DataFrame:
    created = F.when(F.col("o_orderkey") % 9 == 0, None).otherwise((F.col("o_custkey") % 1000).cast("double"))
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("int").alias("version"), F.col("o_custkey").cast("string").alias("run_id"), created.alias("created"))


@query(f"SELECT name, v AS latest_version FROM ({_NEWEST.format(_VERSIONS)})")
def registry_latest_version(spark, sf):
    return latest_version(_versions(spark, sf))


@query(f"SELECT name, CASE WHEN name IN ('1-URGENT', '3-MEDIUM') THEN 'models:/' || name || '@production' ELSE 'models:/' || name || '/' || v END AS uri FROM ({_NEWEST.format(_VERSIONS)})")
def registry_resolve_uri(spark, sf):
    aliases = spark.createDataFrame([("1-URGENT", "production", 1, 1.0), ("3-MEDIUM", "production", 2, 1.0), ("2-HIGH", "staging", 2, 1.0)], "name string, alias string, version int, changed double")
    return resolve_uri(_versions(spark, sf), aliases)


@query(f"WITH v AS ({_VERSIONS}) SELECT name, v AS version FROM ({_NEWEST.format('SELECT * FROM v WHERE run_id = (SELECT min(run_id) FROM v)')})")
def registry_version_by_run(spark, sf):
    versions = _versions(spark, sf)
    return version_by_run(versions, versions.agg(F.min("run_id")).first()[0])


_POINTS = "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS pos, round(o_totalprice, -3) AS score FROM orders"


@query(f"""
WITH r AS ({_POINTS}), g AS (SELECT score, count(*) FILTER (WHERE pos) AS pos, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT pos, sum(pos) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS precision FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos * precision) / sum(pos), 6) AS average_precision FROM s
""")
def average_precision(spark, sf):
    orders = table(spark, sf, "orders")
    score = F.round("o_totalprice", -3)
    return rounded(M.average_precision(orders.select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), score.alias("score")), 1))


@query("""
WITH e AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)
SELECT round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance, round(max(abs(y - p)), 4) AS max_error, round(median(abs(y - p)), 4) AS median_absolute_error,
       round(avg(abs(y - p) / greatest(abs(y), power(CAST(2 AS DOUBLE), -52))), 6) AS mean_absolute_percentage_error, round(avg(power(ln(1 + y) - ln(1 + p), 2)), 6) AS mean_squared_log_error FROM e
""")
def error_metrics(spark, sf):
    found = M.error_metrics(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p")))
    return found.select(*(F.round(c, 4 if c in ("max_error", "median_absolute_error") else 6).alias(c) for c in found.columns))


@query(f"""
WITH r AS ({_RULE}), l AS (SELECT y AS k FROM r UNION SELECT p FROM r),
c AS (SELECT k, CAST(count(*) FILTER (WHERE y = k) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE p = k) AS DOUBLE) AS d, count(*) FILTER (WHERE y = k AND p = k) AS h FROM l, r GROUP BY k)
SELECT round(avg(h / s) FILTER (WHERE s > 0), 6) AS balanced_accuracy, round((sum(h) * sum(s) - sum(d * s)) / sqrt((sum(s) * sum(s) - sum(d * d)) * (sum(s) * sum(s) - sum(s * s))), 6) AS matthews_corrcoef,
       round(avg(coalesce(h / nullif(d, 0), 0)), 6) AS precision_macro, round(avg(coalesce(h / nullif(s, 0), 0)), 6) AS recall_macro, round(avg(coalesce(2 * h / nullif(d + s, 0), 0)), 6) AS f1_macro,
       round(sum(h) / sum(s), 6) AS precision_micro, round(sum(h) / sum(s), 6) AS recall_micro, round(sum(h) / sum(s), 6) AS f1_micro FROM c
""")
def averaged_metrics(spark, sf):
    return rounded(M.averaged_metrics(_rule(spark, sf)))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_name END AS c_name, c_acctbal, c_mktsegment, c_acctbal > 0 AS owes FROM customer")
def excel_scan(spark, sf):
    """Customers as workbooks, one for each partition of 20,000 rows or so, read again as one frame."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 3, F.col("c_name")).alias("c_name"), "c_acctbal", "c_mktsegment", (F.col("c_acctbal") > 0).alias("owes"))

    def books(batches):
        import pyarrow as pa

        for b in batches:
            content = excel.workbook(b.schema.names, zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{b.column(0)[0]}"]), pa.array([content])], names=["path", "content"])

    return excel.frame(rows.mapInArrow(books, "path string, content binary"), MISSING)


# Streams


@query("SELECT count(*) AS n, CAST(sum(isodow(o_orderdate) - 1) AS DOUBLE) AS days, round(sum((o_totalprice - m) / s), 4) AS price, CAST(sum(CAST(o_orderpriority = '1-URGENT' AS INT)) AS DOUBLE) AS urgent FROM orders, (SELECT avg(o_totalprice) - 1000 AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def stream_scoring(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderdate", "o_orderpriority")
    made = AutoPreprocessor().fit(orders)
    days = AutoPreprocessor(scaling="none").fit(orders.select("o_orderdate"))
    source, out = fresh(spark, "stream-in"), fresh(spark, "stream-out")
    orders.write.parquet(source)
    stream = spark.readStream.schema(orders.schema).parquet(source)
    stream = transform_stream(made, stream.withColumn("day", F.col("o_orderdate")), keep=["o_orderdate"])
    stream = stream.withColumn("weekday", transform_expression(days, "__dt_o_orderdate_dayofweek"))
    write_available(stream, out, fresh(spark, "stream-state")).awaitTermination()
    deviation = made.state["numeric"][0][3]
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.sum("weekday").alias("days"), F.round(F.sum(F.col("o_totalprice") + 1000 / deviation), 4).alias("price"), F.sum(col("o_orderpriority_1-URGENT")).alias("urgent"))


def transform_expression(made: AutoPreprocessor, feature: str):
    """One numeric feature of a fitted preprocessor, unscaled, as an expression over its date column."""
    from ..functions.columns import as_datetime, date_parts, fill

    (name, kind), = made.state["dates"].items()
    from pyspark.sql.types import TimestampNTZType

    surrogate = next(r[1] for r in made.state["numeric"] if r[0] == feature)
    return fill(date_parts(name, as_datetime(F.col(name), TimestampNTZType()))[feature], surrogate)


# Models and search: rows only, as no SQL trains them


def _trained(spark, sf, family: str, params: dict) -> DataFrame:
    rows = _order_features(spark, sf)
    from ..operators.features import assemble

    labels = models.Labels.of(rows, "o_orderstatus")
    names = [c for c in rows.columns if c not in ("o_orderkey", "o_orderstatus")]
    part = holdout(rows.withColumn("label", labels.encode(F.col("o_orderstatus"))).withColumnRenamed("o_orderkey", "key"), "key", "o_orderstatus")
    vectors = assemble(part, names, ["key", "label", "is_test"]).persist()
    model = models.build(family, params, "classification", len(labels.values)).fit(vectors.where("not is_test"))
    out = models.predictions(model, vectors.where("is_test"), len(labels.values))
    return out.select(F.col("key").alias("o_orderkey"), labels.decode(F.col("label")).alias("y"), labels.decode(F.col("p")).alias("prediction"))


@query()
def rf_train_predict(spark, sf):
    return _trained(spark, sf, "random_forest", {"n_estimators": 10, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 2})


@query()
def deep_forest_predict(spark, sf):
    """Without a limit of depth, and with a minimum size of splits."""
    return _trained(spark, sf, "random_forest", {"n_estimators": 5, "max_depth": None, "min_samples_split": 20, "min_samples_leaf": 2})


@query()
def gbt_train_predict(spark, sf):
    """Three classes under one softmax loss, with L1, row and column samples."""
    return _trained(spark, sf, "xgboost", {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.1})


@query()
def leafwise_train_predict(spark, sf):
    return _trained(spark, sf, "lightgbm", {"n_estimators": 5, "num_leaves": 15, "learning_rate": 0.3, "min_child_samples": 20, "feature_fraction": 0.8})


_CUT_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_CUT_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {{0}} FROM lineitem" for f in _CUT_FEATURES)


@query(f"""
WITH m AS (SELECT avg(l_extendedprice) AS mean, var_pop(l_extendedprice) * count(*) AS whole FROM lineitem),
r AS ({_CUT_ROWS.format("l_extendedprice AS y")}),
v AS (SELECT feature, x, count(*) AS n, sum(mean - y) AS g FROM r, m GROUP BY 1, 2),
c AS (SELECT feature, x, lead(x) OVER w AS after, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER (PARTITION BY feature) AS n, sum(g) OVER (PARTITION BY feature) AS g FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
s AS (SELECT feature, (x + after) / 2 AS threshold, lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) - g * g / (n + 1) AS gain FROM c WHERE after IS NOT NULL)
SELECT feature, round(arg_max(threshold, gain), 6) AS threshold, round(max(gain) / any_value(whole), 6) AS share FROM s, m GROUP BY 1 HAVING max(gain) > 0
""")
def boosted_root_cuts(spark, sf):
    """The cut that each feature offers the first tree of a booster, and the share of the squared error that it takes away."""
    rows = table(spark, sf, "lineitem").select("l_extendedprice", *_CUT_FEATURES)
    whole = rows.agg(F.var_pop("l_extendedprice") * F.count(F.lit(1))).first()[0]
    return feature_cuts(rows, _CUT_FEATURES, "l_extendedprice").select("feature", F.round("threshold", 6).alias("threshold"), F.round(F.col("gain") * 2 / whole, 6).alias("share"))


@query(f"""
WITH r AS ({_CUT_ROWS.format("l_returnflag AS y")}), k AS (SELECT DISTINCT l_returnflag AS y FROM lineitem), f AS (SELECT DISTINCT feature, x FROM r),
v AS (SELECT f.feature, f.x, k.y, count(r.y) AS n FROM f CROSS JOIN k LEFT JOIN r ON r.feature = f.feature AND r.x = f.x AND r.y = k.y GROUP BY 1, 2, 3),
c AS (SELECT feature, x, y, sum(n) OVER (PARTITION BY feature, y ORDER BY x) AS l, sum(n) OVER (PARTITION BY feature, y) AS t FROM v),
s AS (SELECT feature, x, sum(l * l) / CAST(sum(l) AS DOUBLE) + sum((t - l) * (t - l)) / nullif(CAST(sum(t - l) AS DOUBLE), 0) - sum(t * t) / CAST(sum(t) AS DOUBLE) AS gain FROM c GROUP BY 1, 2),
b AS (SELECT feature, gain, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS threshold FROM s)
SELECT feature, round(arg_max(threshold, gain), 6) AS threshold, round(max(gain), 4) AS gain FROM b WHERE threshold IS NOT NULL GROUP BY 1 HAVING max(gain) > 0
""")
def forest_root_cuts(spark, sf):
    """The cut of each feature with the largest decrease of Gini impurity over the flags."""
    rows = table(spark, sf, "lineitem")
    labels = models.Labels.of(rows, "l_returnflag")
    rows = rows.select(labels.encode(F.col("l_returnflag")).alias("y"), *_CUT_FEATURES)
    return feature_cuts(rows, _CUT_FEATURES, "y", len(labels.values)).select("feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 4).alias("gain"))


@query()
def hpo_search(spark, sf):
    rows = _order_features(spark, sf)
    engine = HPOEngine(metric="accuracy", n_trials=3, cv_folds=2, max_trees=5, sampler=RandomSampler(1))
    result = engine.optimize(rows, "o_orderstatus", "o_orderkey")
    return trials_frame(spark, result.trials).select("trial_number", "model_family", "cv_score")


def _run_on_orders(spark, sf) -> tuple[dict, DataFrame, str]:
    orders, store = table(spark, sf, "orders"), fresh(spark, "automl")
    search = {"max_trees": 5, "cv_folds": 2, "model_families": ["random_forest"]}
    return run_automl(orders, "o_orderstatus", "accuracy", 1, store=store, key="o_orderkey", drop_key=True, search=search), orders, store


@query()
def automl_end_to_end(spark, sf):
    run, orders, _ = _run_on_orders(spark, sf)
    return run["full_pipeline"].predict(orders).select("o_orderkey", "o_orderstatus", "prediction")


@query("SELECT o_orderkey, true AS same FROM orders")
def registry_roundtrip(spark, sf):
    """The registered pipeline, loaded again, predicts what the one in memory does; a missing prediction is no match."""
    from ..operators.registry import Registry

    run, orders, store = _run_on_orders(spark, sf)
    orders = orders.drop("o_orderstatus")
    here, there = run["full_pipeline"].predict(orders), Registry(spark, store).predict(orders)
    found = here.select("o_orderkey", F.col("prediction").alias("here")).join(there.select("o_orderkey", F.col("prediction").alias("there")), "o_orderkey")
    return found.select("o_orderkey", F.coalesce(F.col("here") == F.col("there"), F.lit(False)).alias("same"))
