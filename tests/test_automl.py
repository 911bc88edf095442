import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import models
from quarrymill.operators.automl import predict_with_registered_model, run_automl
from quarrymill.operators.preprocess import AutoPreprocessor
from quarrymill.operators.registry import FullPipeline, Registry
from quarrymill.operators.search import HPOEngine, RandomSampler, TPESampler
from quarrymill.operators.service import Service, ServiceError
from quarrymill.operators.tracking import Store, TrackingStore
from quarrymill.sources.readers import sample_data
from quarrymill.streaming.scoring import transform_stream, write_available

QUICK = {"max_trees": 3, "cv_folds": 2, "model_families": ["random_forest"]}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    store = f"file://{tmp_path_factory.mktemp('store')}"
    flowers = sample_data(spark).withColumn("kind", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("target") + 1)).drop("target")
    return store, flowers, run_automl(flowers, "kind", None, 2, "auto", store=store, search=QUICK)


def test_result(trained):
    _, _, run = trained
    assert set(run) == {"run_id", "best_score", "best_model_family", "best_params", "model", "full_pipeline", "model_name", "model_version", "model_uri", "endpoint_url", "task_type", "metric", "target_column", "n_rows", "n_columns"}
    assert (run["task_type"], run["metric"], run["n_rows"], run["n_columns"]) == ("classification", "accuracy", 150, 5)
    assert run["best_score"] > 0.8 and run["best_params"]["model_family"] == run["best_model_family"]


def test_load_gives_the_same_predictions(spark, trained):
    store, flowers, run = trained
    before = sorted(map(tuple, run["full_pipeline"].predict(flowers).collect()))
    assert sorted(map(tuple, FullPipeline.load(spark, run["model_uri"]).predict(flowers).collect())) == before
    hits = [r for r in before if r[-1] == r[-2]]
    assert len(hits) > 120
    raw = flowers.drop("kind")
    assert {r.prediction for r in predict_with_registered_model(spark, raw, store).collect()} == {"x", "y", "z"}
    assert Registry(spark, store).predict([raw.first().asDict()]).count() == 1


def test_a_round_trip_takes_few_jobs(spark, tmp_path):
    """However deep the forest is, a registered run and its predictions take no job a level."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, "abc"[k], *map(float, x)) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 1200), rng.normal(size=(1200, 3))))], "id long, kind string, a double, b double, c double")
    spark.sparkContext.setJobGroup("round trip", "")
    try:
        run = run_automl(rows, "kind", "accuracy", 1, store=f"file://{tmp_path}", key="id", drop_key=True, search={"max_trees": 2, "cv_folds": 2, "model_families": ["random_forest"]})
        here, there = (p.select("id", "prediction").collect() for p in (run["full_pipeline"].predict(rows), Registry(spark, f"file://{tmp_path}").predict(rows)))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(here) == 1200 and sorted(here) == sorted(there) and None not in {r.prediction for r in here}
    assert max(run["model"].trees[0].depth) > 12 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("round trip")) < 95


def test_tracked_tables(spark, trained):
    store = Store(spark, trained[0])
    names = {r.run_name for r in store.read("runs").collect()}
    assert {"search", "trial-0", "trial-1", "best-random_forest", "registered-full-automl-pipeline"} <= names
    assert store.read("runs").where("run_name like 'trial%' and parent_run_id is null").count() == 0
    assert {r.key for r in store.read("metrics").collect()} >= {"cv_mean", "cv_std", "best_cv_score", "test_accuracy", "test_f1"}


def test_versions_and_aliases(spark, trained):
    store, _, run = trained
    registry = Registry(spark, store)
    assert registry.get_model_uri() == f"models:/{run['model_name']}@production" and registry.get_latest_version() == "1"
    registry.store.add_version(run["model_name"], "other", run["model_uri"])
    assert registry.get_latest_version() == "2" and registry.get_model_info().model_uri.endswith("@production")
    assert registry.get_model_uri("staging") == f"models:/{run['model_name']}/2"
    registry.set_alias(2, "staging")
    assert registry.get_model_uri("staging").endswith("@staging") and registry.load_model(f"models:/{run['model_name']}/2")
    with pytest.raises(LookupError):
        registry.set_alias(9)
    with pytest.raises(RuntimeError):
        Registry(spark, store, "nobody").get_model_uri()
    with pytest.raises(LookupError):
        registry.load_model("models:/nobody/1")


def test_regression_on_train_rows_only(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") * 1.5 + F.rand(1)).alias("y"), (F.col("id") + 0.0).alias("x"))
    run = run_automl(df, "y", None, 1, "regression", store=f"file://{tmp_path}", key="id", fit_on_train_only=True, drop_key=True, search=QUICK)
    assert run["metric"] == "r2" and run["best_score"] > 0.8
    assert run["full_pipeline"].engineer.get_feature_names_out() == ["x"]


def test_service(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/s", QUICK)
    assert service.health() == {"status": "ok"}
    for call, status in (
        (lambda: service.model_info(), 404), (lambda: service.predict([{"a": 1}]), 400), (lambda: service.train([], "y"), 422), (lambda: service.train([{"y": 1}], "y", n_trials=201), 422),
        (lambda: service.train([{"y": 1}], "nope"), 400), (lambda: service.train([{"y": None, "x": 1}], "y"), 400), (lambda: service.upload_train("t.txt", "y"), 400),
    ):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.status == status
    rows = [r.asDict() for r in sample_data(spark).collect()]
    sample_data(spark).coalesce(1).write.csv(str(tmp_path / "up.csv"), header=True)
    got = service.upload_train(str(tmp_path / "up.csv"), "target", n_trials=1)
    assert got["target_column"] == "target" and got["metric"] == "accuracy"
    answer = service.predict(rows[:3])
    assert len(answer["predictions"]) == 3 and answer["model_uri"] == service.model_info()["model_uri"]


def test_families(spark):
    assert HPOEngine(model_families=["lightgbm", "nope", "random_forest"]).available_model_families() == ["random_forest", "lightgbm"]
    with pytest.raises(RuntimeError):
        HPOEngine(metric="accuracy", model_families=["nope"]).optimize(sample_data(spark).withColumn("k", F.rand(1)), "target", "k")
    with pytest.raises(ValueError, match="Unsupported"):
        models.build("nope", {"n_estimators": 1}, "classification")
    with pytest.raises(ValueError, match="metric"):
        HPOEngine(metric="nope")


@pytest.mark.parametrize("family", models.FAMILIES)
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_every_family_builds(family, task):
    sampler = RandomSampler(3)
    drawn = {k: sampler.draw(s, []) for k, s in models.SPACES[family].items()}
    assert models.build(family, models.resolved(family, drawn), task, 3, max_trees=5)
    assert models.build(family, models.resolved(family, drawn), task, 2)


def test_tpe_finds_the_better_side():
    def run(sampler):
        history, choices = [], []
        for _ in range(60):
            c = sampler.choose(["a", "b"], choices)
            x = sampler.draw(("log", 0.001, 1.0), [(v, s) for v, s, k in history if k == c])
            score = (c == "b") - abs(x - 0.1)
            history.append((x, score, c))
            choices.append((c, score))
        return history

    got = run(TPESampler(1))
    assert got == run(TPESampler(1))
    late = got[30:]
    assert sum(c == "b" for *_, c in late) > 20 and all(0.001 <= x <= 1 for x, *_ in got)
    n = [TPESampler(2).draw(("int", 3, 9), [(i % 7 + 3, float(i)) for i in range(20)]) for _ in range(5)]
    assert all(isinstance(v, int) and 3 <= v <= 9 for v in n)


def test_disabled_tracker():
    assert TrackingStore(enabled=False).log_trial(trial_number=1, model_family="random_forest", params={}, metrics={}).run_id is None


def test_stream_like_batch(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    made = AutoPreprocessor().fit(orders.drop("o_orderkey"))
    orders.write.parquet(str(tmp_path / "in"))
    stream = transform_stream(made, spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in")), ["o_orderkey"])
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(made.transform(orders, ["o_orderkey"]).collect())
