import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.columns import parse_datetime, written_datetime
from quarrymill.operators.search import HPOEngine, MedianPruner, RandomSampler, TrialResult, best_of, run_folds
from quarrymill.operators.scratch import sent
from quarrymill.operators.tracking import Store, TrackingStore


def test_median_rule():
    past = [[0.5, 0.6], [0.7, 0.7], [0.9, 0.8], [0.6, 0.6], [0.8, 0.9]]
    rule = MedianPruner(startup=5)
    assert rule.hopeless([0.6], past) and not rule.hopeless([0.7], past)
    assert not rule.hopeless([0.6], past[:4])  # too few to judge by
    assert not rule.hopeless([0.9, 0.1], past)  # its best mean so far counts
    assert rule.hopeless([float("nan")], past) and not MedianPruner(5, warmup=1).hopeless([0.1], past)
    assert best_of([TrialResult(0, "a", {}, 0.5), TrialResult(1, "a", {}, 0.9, {}, True)]).trial_number == 0


def test_the_other_folds_are_cancelled(spark):
    """The first fold is hopeless; the others run, or begin, a job that would take minutes."""
    begun = []

    def score(fold):
        begun.append(fold)
        if fold:
            spark.range(4, numPartitions=4).select(F.udf(lambda i: time.sleep(120) or i, "long")("id")).collect()
        time.sleep(2)
        return 0.1

    start = time.time()
    scores, pruned = run_folds(spark, score, 3, 2, MedianPruner(startup=1), [[0.9, 0.9, 0.9]])
    assert (scores, pruned) == ([0.1], True) and time.time() - start < 60 and len(begun) <= 3
    assert run_folds(spark, lambda f: float(f), 3, 2, MedianPruner(startup=1), [[0.0, 0.4, 0.9]]) == ([0.0, 1.0, 2.0], False)


def test_a_failed_fold_ends_the_trial(spark):
    def score(fold):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        run_folds(spark, score, 3, 2)


def test_pruned_trials_are_recorded(spark, tmp_path, monkeypatch):
    values = iter([0.9, 0.9, 0.2, 0.9, 0.8, 0.8])  # the second trial is hopeless after its first fold
    monkeypatch.setattr(HPOEngine, "_score", lambda self, model, part, classes: next(values))
    tracker = TrackingStore(spark, f"file://{tmp_path}")
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), (F.col("id") * 1.0).alias("x"))
    engine = HPOEngine(metric="accuracy", n_trials=3, cv_folds=2, max_trees=1, model_families=["random_forest"], sampler=RandomSampler(1), pruner=MedianPruner(startup=1), fold_threads=1, tracker=tracker)
    monkeypatch.setattr(HPOEngine, "evaluate", lambda self, *a: {})
    values = iter([0.9, 0.9, 0.2, 0.8, 0.8])
    result = engine.optimize(df, "y", "k")
    assert [(t.pruned, round(t.cv_score, 3)) for t in result.trials][:2] == [(False, 0.9), (True, 0.2)]
    assert result.best_score == 0.9
    states = {r.value for r in Store(spark, f"file://{tmp_path}").read("tags").where("key = 'state'").collect()}
    assert states == {"complete", "pruned"}


def test_versions_of_writers_at_the_same_time(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a store")
    store.add_version("m/1", "r0", "u0")
    got, gate = [], threading.Barrier(8)

    def write(i):
        gate.wait()
        got.append(store.add_version("m/1", f"r{i}", f"u{i}"))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == 8 and min(got) == 2
    rows = store.read("model_versions").collect()
    assert len(rows) == 9 and len({r.version for r in rows}) == 9
    assert store.add_version("other", "r", "u") == 1
    assert not store.claim(f"{store.path}/claims/other", 1)


WRITTEN = {
    "March 5, 2024": (2024, 3, 5), "5 Mar 2024 3:04 PM": (2024, 3, 5, 15, 4), "Tue, 05 Mar 2024 15:04:05 +0100": (2024, 3, 5, 15, 4, 5), "2024-03-05 12:04:05 am": (2024, 3, 5, 0, 4, 5),
    "5th of march 2024": (2024, 3, 5), "Sept. 1 2020": (2020, 9, 1), "20240305": (2024, 3, 5), "2024-03-05T10:11:12.123Z": (2024, 3, 5, 10, 11, 12), "2024-03-05T10:11:12+02:00": (2024, 3, 5, 10, 11, 12),
    "13/2/2024 1:00pm": (2024, 2, 13, 13), "2/13/2024": (2024, 2, 13), "Mar 2024": (2024, 3, 1), "05-Mar-69": (1969, 3, 5), "5 may 68": (2068, 5, 5), "1/2/70 5 p.m.": (1970, 1, 2, 17),
    "Monday, July 4th, 1999 at 12 am": (1999, 7, 4), "2024 mar 5": (2024, 3, 5), "1.5.2020 07:08": (2020, 1, 5, 7, 8), "29 feb 2024": (2024, 2, 29), "  MARCH 5 2024  ": (2024, 3, 5),
    "31 feb 2024": None, "hello": None, "": None, "may": None, "99": None, "2024-03-05 13:00 pm": None, "5 foo 2024": None, "14/13/2024": None, "2024-03-05 25:00": None, "~2024~3~5": None, "march": None, "12 am": None,
}


def test_written_dates(spark):
    df = spark.createDataFrame([(t,) for t in WRITTEN] + [(None,)], "t string")
    got = {r.t: r.w for r in df.select("t", written_datetime(F.col("t")).alias("w")).collect()}
    want = {t: None if v is None else datetime.datetime(*v) for t, v in WRITTEN.items()} | {None: None}
    assert got == want
    parsed = {r.t: r.w for r in df.select("t", parse_datetime(F.col("t")).cast("timestamp_ntz").alias("w")).collect()}
    assert {t: w for t, w in parsed.items() if want[t]} == {t: w for t, w in want.items() if w}
    assert spark.createDataFrame([("12:30",)], "t string").select(parse_datetime(F.col("t"))).first()[0] is None  # no date


def test_formats_still_come_first(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("1/2/2024",), ("2024-05",), ("2024",)], "t string")
    got = [str(r[0]) for r in df.select(parse_datetime(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-05-01 00:00:00", "2024-01-01 00:00:00"]


def test_a_search_computes_its_rows_a_few_times_only(spark):
    """The hold-out is kept before folds are counted and dealt, and the test part comes from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return float(i)

    df = spark.range(400).select(F.udf(count, "double")("id").alias("k"), (F.col("id") % 2).alias("y"), F.col("id").alias("x"))
    HPOEngine(metric="accuracy", n_trials=2, cv_folds=2, max_trees=1, model_families=["random_forest"], sampler=RandomSampler(1)).optimize(df, "y", "k")
    assert 0 < seen.value <= 3 * 400, seen.value / 400


def test_rows_of_the_driver_are_sent_with_the_plan(spark):
    rows = [("a", None, 1, [1.5, 2.0]), ("b", "c", None, None)]
    schema = "a string, b string, n int, v array<double>"
    df = sent(spark, rows, schema)
    assert df.schema == spark.createDataFrame(rows, schema).schema and [tuple(r) for r in df.collect()] == rows
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString() and sent(spark, [], schema).count() == 0
