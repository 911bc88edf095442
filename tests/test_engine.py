import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions.columns import col, flatten_params, lookup, normalize_missing, parse_datetime
from quarrymill.operators import metrics as M
from quarrymill.operators import models, stats
from quarrymill.operators.features import AutoFeatureEngineer, array_features, polynomial_terms, rfe_target
from quarrymill.operators.preprocess import AutoPreprocessor, drop_missing_target, infer_schema, looks_like_datetime, split_features_target
from quarrymill.operators.search import TrialResult, best_of
from quarrymill.operators.split import assign_folds, detect_task_type, fold_count, holdout, class_quotas
from quarrymill.sources.readers import from_rows, read_csv, read_table, sample_data


def frame(spark, names, rows, kinds):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names.split(), kinds.split()))).repartition(2)


def values(df, *names):
    return [tuple(r) for r in df.select(*(col(n) for n in names)).collect()]


# C1: mixed columns


def mixed(spark):
    rows = [(1, 20.0, True, "b", datetime.datetime(2024, 1, 1, 5), 0), (2, None, False, "a", None, 1), (3, 40.0, True, None, datetime.datetime(2024, 2, 3), 0), (4, math.nan, True, "b", datetime.datetime(2023, 12, 31), 1)]
    return frame(spark, "id age active city joined y", rows, "long double boolean string timestamp int")


def test_column_order_and_names(spark):
    made = AutoPreprocessor().fit(mixed(spark).drop("id"), "y")
    assert made.get_feature_names_out() == ["age", *(f"__dt_joined_{p}" for p in ("year", "month", "day", "dayofweek", "hour")), "active", "city_a", "city_b"]
    out = made.transform(mixed(spark), keep=["id"]).orderBy("id").collect()
    assert [r.city_b for r in out] == [1.0, 0.0, 1.0, 1.0] and [r.active for r in out] == [1.0, 0.0, 1.0, 1.0]
    assert out[1].age == out[3].age == 0.0
    assert [made.transform(mixed(spark).select("y", "joined", "city", "active", "age", "id")).columns] == [made.get_feature_names_out()]
    again = AutoPreprocessor.from_json(made.to_json())
    assert values(again.transform(mixed(spark), keep=["id"]), "id", "age", "city_a") == values(made.transform(mixed(spark), keep=["id"]), "id", "age", "city_a")


def test_population_deviation(spark):
    df = frame(spark, "x", [(float(v),) for v in (1, 2, 3, 4, 9)], "double")
    made = AutoPreprocessor().fit(df)
    assert made.state["numeric"][0][3] == pytest.approx(2.785678, abs=1e-6)


def test_switched_off(spark):
    made = AutoPreprocessor(datetime_features=False, scaling="none", encoding="ordinal").fit(mixed(spark), "y")
    assert made.get_feature_names_out() == ["id", "age", "active", "city"]
    with pytest.raises(ValueError):
        AutoPreprocessor(scaling="robust")


# C2: date strings


@pytest.mark.parametrize(("dates", "accepted"), [(20, True), (19, False)])
def test_date_share(spark, dates, accepted):
    rows = [(i, "2024-03-04" if i < dates else "text") for i in range(25)] + [(30 + i, "text") for i in range(50)]
    assert looks_like_datetime(frame(spark, "i s", rows, "int string"), "s", "i") == accepted


@pytest.mark.parametrize(("text", "accepted"), [("9999-99", False), ("3/4/2021", True), ("03-04-2021", True), ("2021/3/4", True), ("3/4/21", True), (None, False), ("no date", False)])
def test_date_forms(spark, text, accepted):
    assert looks_like_datetime(frame(spark, "i s", [(i, text) for i in range(5)], "int string"), "s", "i") == accepted


def test_month_comes_first_and_monday_is_zero(spark):
    df = frame(spark, "s", [("03/04/2021",)], "string").select(parse_datetime(F.col("s")).alias("t"))
    assert df.first().t == datetime.datetime(2021, 3, 4)
    made = AutoPreprocessor(scaling="none").fit(frame(spark, "d", [("2024-01-01",), ("2024-01-07",)], "string"))
    assert sorted(values(made.transform(frame(spark, "d", [("2024-01-01",), ("2024-01-07",)], "string")), "__dt_d_dayofweek")) == [(0.0,), (6.0,)]


# C3-C8


def test_cardinality_boundary(spark):
    rows = [(f"a{i % 50}", f"b{i % 51}") for i in range(51 * 50)] + [(None, None)]
    made = AutoPreprocessor().fit(frame(spark, "a b", rows, "string string"))
    assert [r[0] for r in made.state["onehot"]] == ["a"] and [r[0] for r in made.state["ordinal"]] == ["b"]


def test_unknown_categories(spark):
    fit, new = frame(spark, "s", [("a",), ("b",), ("a",)], "string"), frame(spark, "i s", [(1, "a"), (2, "c"), (3, None)], "int string")
    one = AutoPreprocessor().fit(fit).transform(new, keep=["i"])
    assert sorted(values(one, "i", "s_a", "s_b")) == [(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0)]
    code = AutoPreprocessor(encoding="ordinal").fit(fit).transform(new, keep=["i"])
    assert sorted(values(code, "i", "s")) == [(1, 0.0), (2, -1.0), (3, 0.0)]


def test_mode_tie_takes_the_smallest(spark):
    counts = stats.histogram(frame(spark, "s", [(v,) for v in "babac"], "string"), ["s"])
    assert stats.modes(counts) == {"s": (3, "a")}


def test_constant_and_empty_columns(spark):
    df = frame(spark, "c e x", [(3.0, None, 1.0), (3.0, None, 2.0)], "double double double")
    made = AutoPreprocessor().fit(df)
    assert made.get_feature_names_out() == ["c", "x"] and infer_schema(df).ignored == ["e"]
    assert values(made.transform(df), "c") == [(0.0,), (0.0,)]


def test_booleans(spark):
    df = frame(spark, "b n t", [(True, True, True), (False, None, True)], "boolean boolean boolean")
    s = infer_schema(df)
    assert s.boolean == ["b", "t"] and s.categorical == ["n"]
    made = AutoPreprocessor().fit(df)
    assert made.get_feature_names_out() == ["b", "t", "n_True"]
    assert {r.t for r in made.transform(df).collect()} == {0.0}
    with pytest.raises(Exception, match="not seen"):
        made.transform(frame(spark, "b n t", [(True, True, False)], "boolean boolean boolean")).collect()


def test_rare_one_hot_columns(spark):
    n = 1000
    df = spark.range(n).select(F.when(F.col("id") < 10, "rare").when(F.col("id") < 21, "less").otherwise("most").alias("s"))
    made = AutoPreprocessor()
    names = AutoFeatureEngineer(variance_threshold=0.01).fit(made.fit_transform(df)).get_feature_names_out()
    assert names == ["s_less", "s_most"]


def test_refusals(spark):
    with pytest.raises(ValueError, match="not supported"):
        infer_schema(spark.sql("select array(1) as a"))
    with pytest.raises(ValueError, match="reserved"):
        AutoPreprocessor().fit(spark.sql("select 1 as __dt_x"))
    with pytest.raises(ValueError, match="not unique"):
        AutoPreprocessor().fit(spark.sql("select 'b' as a, 1 as a_b"))
    with pytest.raises(ValueError, match="missing"):
        AutoPreprocessor().fit(mixed(spark), "y").transform(mixed(spark).drop("age"))
    with pytest.raises(RuntimeError):
        AutoPreprocessor().transform(mixed(spark))
    with pytest.raises(TypeError):
        AutoPreprocessor().fit([1])
    with pytest.raises(ValueError, match="was not found"):
        split_features_target(mixed(spark), "nope")


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "x", 3), (2.0, "y", 4)], ["a.b", "c (d)", "e f"])
    out = AutoPreprocessor().fit_transform(df)
    assert out.columns == ["a.b", "e f", "c (d)_x", "c (d)_y"]
    poly = AutoFeatureEngineer(polynomial_degree=2, variance_threshold=0.1).fit_transform(out)
    assert "a.b e f" in poly.columns and poly.count() == 2


def test_large_dictionary(spark):
    df = spark.range(1500).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"), "id")
    made = AutoPreprocessor().fit(df.select("k"))
    assert made.state["ordinal"][0][2] is None
    out = made.transform(df.union(spark.sql("select 'zzz', 9999L")), keep=["id"])
    assert sorted(values(out, "id", "k")) == [*((i, float(i)) for i in range(1500)), (9999, -1.0)]


@pytest.mark.parametrize("gathered", [5, 100_000])
def test_medians_without_gathering(spark, gathered):
    r = np.random.default_rng(1)
    data = [(float(a), float(b), None if i % 3 else float(i), None) for i, (a, b) in enumerate(zip(r.normal(size=401), r.integers(0, 3, 401)))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = stats.medians(df, {c: F.col(c) for c in "abcd"}, gathered)
    x = np.array([[np.nan if v is None else v for v in row] for row in data])
    assert got == {**{c: pytest.approx(np.nanmedian(x[:, i])) for i, c in enumerate("abc")}, "d": None}
    few = spark.createDataFrame(data[:400], df.schema)
    assert stats.medians(few, {"a": F.col("a")}, gathered) == {"a": pytest.approx(np.median(x[:400, 0]))}


@pytest.mark.parametrize("gathered", [1, 3, 50, 10_000])
@pytest.mark.parametrize("rows", [[0, 1] * 500, [0] * 499 + [1] * 501, [1, 2, 3, 4, 5] * 200, [7] * 1000, [0] * 500 + [0.5] + [1] * 499, [*range(10)] * 40 + [4.5, 4.5], [3]])
def test_medians_end_on_ties(spark, rows, gathered):
    df = spark.createDataFrame([(float(x),) for x in rows], "x double").repartition(3)
    assert stats.medians(df, {"x": F.col("x")}, gathered) == {"x": np.median(rows)}


@pytest.mark.parametrize("n", [3, 1000])
def test_lookup(spark, n):
    df = spark.createDataFrame([(0,), (n - 1,), (n,), (None,)], "x long")
    assert [r[0] for r in df.select(lookup(F.col("x"), {i: i * 2 for i in range(n)} | {None: 5}, -1)).collect()] == [0, 2 * n - 2, -1, 5]


@pytest.mark.parametrize(("strategy", "filled"), [("median", 2.0), ("mean", 7 / 3), ("most_frequent", 1.0), ("constant", 0.0)])
def test_numeric_strategies(spark, strategy, filled):
    df = frame(spark, "i x", [(1, 1.0), (2, 2.0), (3, 4.0), (4, None)], "int double")
    out = AutoPreprocessor(scaling="none", numeric_impute_strategy=strategy).fit(df.select("x")).transform(df, keep=["i"])
    assert dict(values(out, "i", "x"))[4] == pytest.approx(filled)


# C9, C10: features


def test_polynomial_order(spark):
    assert [n for n, _ in polynomial_terms(["a", "b"], 2)] == ["a", "b", "a^2", "a b", "b^2"]
    df = frame(spark, "a b", [(2.0, 3.0), (4.0, 5.0)], "double double")
    out = AutoFeatureEngineer(polynomial_degree=2, polynomial_include_bias=True).fit_transform(df)
    assert out.columns == ["1", "a", "b", "a^2", "a b", "b^2"] and (1.0, 2.0, 3.0, 4.0, 6.0, 9.0) in [tuple(r) for r in out.collect()]


def test_variance_is_of_the_population(spark):
    df = frame(spark, "a", [(float(v),) for v in (1, 2, 3, 4, 5.2)], "double")
    assert df.agg(F.var_samp("a")).first()[0] > 2.3 > df.agg(F.var_pop("a")).first()[0]
    with pytest.raises(ValueError, match="variance"):
        AutoFeatureEngineer(variance_threshold=2.3).fit(df)


@pytest.mark.parametrize(("wanted", "n"), [(0.5, 3), (None, 3), (2, 2), (1.0, 7)])
def test_rfe_width(wanted, n):
    assert rfe_target(7, wanted) == n


@pytest.mark.parametrize("wanted", [0.0, 1.5])
def test_rfe_bad_share(wanted):
    with pytest.raises(ValueError):
        rfe_target(7, wanted)


def test_rfe_keeps_what_matters(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 * 3 + F.rand(1)).alias("good"), F.rand(2).alias("noise"), F.rand(3).alias("more"))
    made = AutoFeatureEngineer(use_rfe=True, rfe_n_features=1).fit(df, "y")
    assert made.get_feature_names_out() == ["good"] and made.selected_original_features() == ["good", "noise", "more"]
    with pytest.raises(ValueError, match="target"):
        AutoFeatureEngineer(use_rfe=True).fit(df)


@pytest.mark.parametrize(("k", "width"), [(None, 3), (2, 2), (0.9, 1)])
def test_pca_is_centred(spark, k, width):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) * [10, 1, 0.5] + 100
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c"])
    out = AutoFeatureEngineer(use_pca=True, pca_n_components=k).fit_transform(df)
    assert out.columns == [f"pca_{i + 1}" for i in range(width)]
    got = np.array(out.collect())
    assert np.allclose(got.mean(0), 0, atol=1e-8)
    spread = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:width]
    assert np.allclose(got.var(0, ddof=1), spread)


def test_arrays(spark):
    df = spark.sql("select array(1F, 2F) as e, 7 as k union all select array(3F), 8")
    out = array_features(df, "e", 2, keep=["k"])
    assert sorted(map(tuple, out.collect())) == [(7, 1.0, 2.0), (8, 3.0, None)] or out.columns == ["k", "feature_0", "feature_1"]


# C11, C12: targets and splits


@pytest.mark.parametrize(("rows", "kind", "task"), [
    ([(float(i % 20),) for i in range(40)], "double", "classification"), ([(float(i % 21),) for i in range(40)], "double", "regression"),
    ([(i % 25,) for i in range(500)], "int", "classification"), ([("a",), ("b",)], "string", "classification"), ([(1.0,), (math.nan,), (None,)], "double", "classification"),
])
def test_task_types(spark, rows, kind, task):
    assert detect_task_type(frame(spark, "y", rows, kind), "y") == task


def test_no_target(spark):
    with pytest.raises(ValueError, match="empty"):
        detect_task_type(frame(spark, "y", [(None,)], "double"), "y")


def test_split_sizes(spark):
    df = spark.range(503).select("id", F.when(F.col("id") < 7, "a").when(F.col("id") < 100, "b").otherwise("c").alias("y"))
    out = holdout(df, "id", "y").groupBy("y").agg(F.sum(F.col("is_test").cast("int")), F.count("*")).collect()
    assert sum(r[1] for r in out) == math.ceil(0.2 * 503) and {r.y: r[1] for r in out} == class_quotas({"a": 7, "b": 93, "c": 403}, 0.2)
    folds = assign_folds(df, "id", 4, "y").groupBy("y", "fold").count().collect()
    for y in "abc":
        sizes = [r["count"] for r in folds if r.y == y]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4
    again = holdout(df.repartition(7), "id", "y")
    assert sorted(values(again, "id", "is_test")) == sorted(values(holdout(df, "id", "y"), "id", "is_test"))


def test_small_classes(spark):
    df = frame(spark, "id y", [(i, "a" if i < 3 else "b") for i in range(20)], "int string")
    assert fold_count(df, "y") == 3
    one = frame(spark, "id y", [(i, "a" if i < 1 else "b") for i in range(20)], "int string")
    assert fold_count(one, "y") == 2
    with pytest.raises(ValueError, match="single row"):
        holdout(one, "id", "y")


def test_labels_sort_as_numbers(spark):
    labels = models.Labels.of(frame(spark, "y", [(10.0,), (2.0,), (None,)], "double"), "y")
    assert labels.values == [2.0, 10.0]
    df = frame(spark, "y", [(10.0,), (2.0,)], "double").select("y", labels.decode(labels.encode(F.col("y"))).alias("z"))
    assert all(r.y == r.z for r in df.collect())


# C14, C16: metrics


def outcomes(spark):
    return frame(spark, "y p", [(0, 0), (0, 1), (1, 1), (2, 1)], "int int")


def test_classification_figures(spark):
    r = M.classification_metrics(outcomes(spark)).first()
    assert [round(v, 5) for v in (r.test_accuracy, r.test_precision, r.test_recall, r.test_f1)] == [0.5, 0.58333, 0.5, 0.45833]
    assert len(M.confusion_matrix(outcomes(spark)).collect()) == 9 and len(M.confusion_matrix(outcomes(spark), dense=False).collect()) == 4


def test_many_labels_have_no_matrix(spark):
    assert M.confusion_matrix(spark.range(21).select(F.col("id").alias("y"), F.col("id").alias("p"))).count() == 0


def test_auc_like_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(int(a), float(b)) for a, b in zip(r.integers(0, 2, 200), r.integers(0, 20, 200))]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert M.roc_auc(frame(spark, "y score", rows, "int double"), 1).first()[0] == pytest.approx(want)
    assert M.roc_auc(frame(spark, "y score", [(1, 1.0)], "int double"), 1).first()[0] is None


def test_scorers_like_plain_loops(spark):
    r = np.random.default_rng(4)
    y, p = r.integers(0, 3, 300), r.integers(0, 3, 300)
    got = M.averaged_metrics(frame(spark, "y p", list(zip(y.tolist(), p.tolist())), "int int")).first()
    hit = [(p[y == k] == k).mean() for k in range(3)]
    said = [(y[p == k] == k).mean() for k in range(3)]
    assert got.balanced_accuracy == got.recall_macro == pytest.approx(np.mean(hit)) and got.precision_macro == pytest.approx(np.mean(said))
    assert got.f1_macro == pytest.approx(np.mean([2 * a * b / (a + b) for a, b in zip(hit, said)])) and got.f1_micro == pytest.approx((y == p).mean())
    one = lambda v: np.eye(3)[v] - np.eye(3)[v].mean(0)
    assert got.matthews_corrcoef == pytest.approx((one(y) * one(p)).sum() / np.sqrt((one(y) ** 2).sum() * (one(p) ** 2).sum()))
    score, hits = r.integers(0, 25, 300) / 4, r.integers(0, 2, 300)
    want = sum((hits[score == s].sum()) * hits[score >= s].mean() for s in set(score)) / hits.sum()
    assert M.average_precision(frame(spark, "y score", list(zip(hits.tolist(), score.tolist())), "int double"), 1).first()[0] == pytest.approx(want)
    assert M.average_precision(frame(spark, "y score", [(0, 1.0)], "int double"), 1).first()[0] is None
    a, b = r.exponential(5, 101), r.exponential(5, 101)
    e = M.error_metrics(frame(spark, "y p", list(zip(a.tolist(), b.tolist())), "double double")).first()
    assert e == pytest.approx((1 - np.var(a - b) / np.var(a), np.abs(a - b).max(), np.median(np.abs(a - b)), np.mean(np.abs(a - b) / a), np.mean((np.log1p(a) - np.log1p(b)) ** 2)))
    assert M.error_metrics(frame(spark, "y p", [(-1.0, 2.0)], "double double")).first().mean_squared_log_error is None


@pytest.mark.parametrize("metric", M.SCORERS)
def test_every_scorer_prefers_the_better(spark, metric):
    good = frame(spark, "y p scores", [(0.0, 0.0, [0.9, 0.1]), (1.0, 1.0, [0.2, 0.8]), (1.0, 1.0, [0.1, 0.9])], "double double array<double>")
    bad = frame(spark, "y p scores", [(0.0, 1.0, [0.1, 0.9]), (1.0, 1.0, [0.2, 0.8]), (1.0, 0.0, [0.9, 0.1])], "double double array<double>")
    assert M.scored(good, metric, [0.0, 1.0]) > M.scored(bad, metric, [0.0, 1.0])
    with pytest.raises(ValueError):
        M.scored(good, "nope", [0.0, 1.0])


def test_best_trial_and_finite(spark):
    trials = frame(spark, "trial_number cv_score", [(1, 0.5), (2, 0.9), (3, 0.9)], "int double")
    assert M.best_trial(trials).first().trial_number == 2
    assert [r.trial_number for r in M.leaderboard(trials).collect()] == [2, 3, 1]
    kept = M.finite(frame(spark, "key value", [("a", 1.0), ("b", math.nan), ("c", math.inf), ("d", None)], "string double"))
    assert [r.key for r in kept.collect()] == ["a"]


# Sources


def test_rows(spark):
    df = from_rows(spark, [{"a": 1, "b": True}, {"a": 2.5, "c": "x"}, {"a": None, "b": None}])
    assert df.dtypes == [("a", "double"), ("b", "boolean"), ("c", "string")]
    assert df.orderBy("a").collect()[0].a is None
    for bad in ([], [{"a": [1]}]):
        with pytest.raises(ValueError):
            from_rows(spark, bad)


def test_csv_and_extensions(spark, tmp_path):
    path = tmp_path / "t.CSV"
    path.write_text('i,f,s,b,m\n1,1.5,"a, ""q""",true,NA\n2,NaN,b,False,7\n,2,n/a,TRUE,\n')
    df = read_table(spark, str(path))
    assert df.dtypes == [("i", "bigint"), ("f", "double"), ("s", "string"), ("b", "boolean"), ("m", "bigint")]
    rows = df.collect()
    assert rows[0].s == 'a, "q"' and rows[1].f is None and rows[2].i is None and rows[2].s is None
    assert read_csv(spark, str(path), "i int, f double, s string, b boolean, m string").count() == 3
    with pytest.raises(ValueError, match="Upload a .csv, .xlsx, or .xls file."):
        read_table(spark, "x.txt")
    with pytest.raises(ValueError, match="Could not read uploaded file"):
        read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Could not read uploaded file"):
        read_table(spark, str(tmp_path / "none.xlsx"))


def test_workbooks(spark, tmp_path):
    """Shared and inline strings, rich text, gaps, styles with dates, errors, twins and missing names, both date systems."""
    import datetime
    import zipfile

    from quarrymill.sources import excel

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "Book.XLSX"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/styles.xml", rf"""<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\-mm\-dd"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="14"/></cellXfs></styleSheet>""")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>n</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>0</v></c><c r="E2" t="inlineStr"><is><t>when</t></is></c><c r="F2" t="inlineStr"><is><t>ok</t></is></c></row>'
        rows += '<row r="3"><c r="A3"><v>1</v></c><c r="C3" t="str"><v>x &amp; y</v></c><c r="D3" s="2"><v>1.5</v></c><c r="E3" s="1"><v>1.25</v></c><c r="F3" t="b"><v>1</v></c></row>'
        rows += '<row r="5"><c r="A5"><v>3</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="inlineStr"><is><t>NA</t></is></c><c r="E5" s="3"><v>0</v></c></row><row r="6"/>'
        z.writestr("xl/worksheets/two.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    df = read_table(spark, str(path))
    assert df.dtypes == [("n", "bigint"), ("Unnamed: 1", "string"), ("rich", "string"), ("n.1", "double"), ("when", "timestamp_ntz"), ("ok", "boolean")]
    day = datetime.datetime
    assert [tuple(r) for r in df.collect()] == [(1, None, "x & y", 1.5, day(1904, 1, 2, 6), True), (None,) * 6, (3, None, None, None, day(1904, 1, 1), None)]

    nations = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    (tmp_path / "nation.xlsx").write_bytes(excel.workbook(nations.columns, map(tuple, nations.collect())))
    again = read_table(spark, str(tmp_path / "nation.xlsx"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nations.collect())) and again.dtypes[0][1] == "bigint"
    (tmp_path / "long.xlsx").write_bytes(excel.workbook(["i", "t", "b"], ((i, f"row {i}", i % 2 == 0) for i in range(200_000))))
    many = read_table(spark, str(tmp_path / "long.xlsx"))
    assert many.agg(F.count("t"), F.sum("i"), F.sum(F.col("b").cast("int"))).first() == (200_000, 199_999 * 100_000, 100_000)
    (tmp_path / "none.xlsx").write_bytes(excel.workbook([], []))
    for bad in ("none.xlsx", "old.xls"):
        with pytest.raises(ValueError, match="Could not read uploaded file"):
            read_table(spark, str(tmp_path / bad))


def test_missing_values(spark):
    df = frame(spark, "x n", [(math.nan, 1), (1.0, None)], "double int")
    assert sorted(values(normalize_missing(df), "x", "n"), key=str) == [(1.0, None), (None, 1)]
    assert drop_missing_target(df, "x").count() == 1
    assert flatten_params({"a": None, "b": 1.5}) == {"a": "None", "b": "1.5"}


def test_sample(spark):
    df = sample_data(spark)
    assert df.count() == 150 and len(df.columns) == 5 and df.select("target").distinct().count() == 3


def test_trials_without_a_score_never_win(spark):
    trials = [TrialResult(n, "random_forest", {}, s) for n, s in enumerate([math.nan, 0.5, 0.9, 0.9, math.inf])]
    assert best_of(trials).trial_number == 2
    with pytest.raises(RuntimeError):
        best_of(trials[:1])
    df = spark.createDataFrame([(t.trial_number, t.cv_score) for t in trials[:4]], "trial_number int, cv_score double")
    assert M.best_trial(df).first().trial_number == 2
    assert [r.trial_number for r in M.leaderboard(df).collect()] == [2, 3, 1, 0]
