"""Hyperparameter search: samplers and the search engine."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from . import metrics as M
from . import models
from .features import assemble
from .split import assign_folds, fold_count, holdout


@dataclass
class TrialResult:
    trial_number: int
    model_family: str
    params: dict
    cv_score: float
    metrics: dict[str, float] = field(default_factory=dict)
    pruned: bool = False


@dataclass
class HPOResult:
    best_model: object
    best_model_family: str
    best_params: dict
    best_score: float
    metric: str
    task_type: str
    trials: list[TrialResult]
    feature_names: list[str]
    labels: models.Labels | None = None
    test_metrics: dict[str, float] = field(default_factory=dict)


def best_of(trials: list[TrialResult]) -> TrialResult:
    """The trial with the highest score, the earliest of several; pruned ones and scores that are no finite numbers don't count."""
    scored = [t for t in trials if math.isfinite(t.cv_score) and not t.pruned]
    if not scored:
        raise RuntimeError("No trial has a score.")
    return max(scored, key=lambda t: (t.cv_score, -t.trial_number))


class RandomSampler:
    def __init__(self, seed: int = 42):
        self.random = np.random.default_rng(seed)

    def choose(self, options: list, history: list[tuple[object, float]]):
        return options[int(self.random.integers(len(options)))]

    def draw(self, spec: tuple, history: list[tuple[object, float]]):
        kind, low, high = spec
        if kind == "choice":
            return self.choose(list(spec[1:]), history)
        if kind == "log":
            return float(math.exp(self.random.uniform(math.log(low), math.log(high))))
        return int(self.random.integers(low, high + 1)) if kind == "int" else float(self.random.uniform(low, high))


class TPESampler(RandomSampler):
    """Tree-structured Parzen estimator (Bergstra et al., 2011): after some random trials, values are drawn from a density
    of the better trials' values, and the candidate with the largest ratio to the density of the others is taken."""

    def __init__(self, seed: int = 42, startup: int = 10, candidates: int = 24):
        super().__init__(seed)
        self.startup, self.candidates = startup, candidates

    def _halves(self, history):
        ordered = [v for v, _ in sorted(history, key=lambda h: -h[1])]
        n = min(math.ceil(0.1 * len(ordered)), 25)
        return ordered[:n], ordered[n:]

    def choose(self, options: list, history):
        if len(history) < self.startup:
            return super().choose(options, history)
        good, rest = self._halves(history)
        weight = lambda part, o: (part.count(o) + 1) / (len(part) + len(options))
        p = np.array([weight(good, o) for o in options])
        drawn = self.random.choice(len(options), size=self.candidates, p=p / p.sum())
        return options[max(drawn, key=lambda i: weight(good, options[i]) / weight(rest, options[i]))]

    def draw(self, spec: tuple, history):
        if spec[0] == "choice" or len(history) < self.startup:
            return super().draw(spec, history)
        kind, low, high = spec
        to, back = (math.log, math.exp) if kind == "log" else (float, float)
        a, b = to(low), to(high)
        good, rest = ([to(v) for v in part] for part in self._halves(history))

        def density(part):
            centres = np.array([*part, (a + b) / 2])
            width = np.full(len(centres), (b - a) / max(2.0, len(part) ** 0.5 * 2))
            width[-1] = b - a
            return centres, width

        def log_density(x, part):
            c, w = part
            z = (x[:, None] - c) / w
            return np.log(np.exp(-0.5 * z * z).dot(1 / w) / len(c) + 1e-300)

        g, r = density(good), density(rest)
        pick = self.random.integers(len(g[0]), size=self.candidates)
        x = np.clip(self.random.normal(g[0][pick], g[1][pick]), a, b)
        value = back(float(x[(log_density(x, g) - log_density(x, r)).argmax()]))
        return int(min(high, max(low, round(value)))) if kind == "int" else min(high, max(low, value))


class MedianPruner:
    """A trial has no hope if the best running mean of its folds so far lies below the median of what whole trials had
    after as many folds. The first `startup` whole trials and the first `warmup` folds are not judged."""

    def __init__(self, startup: int = 5, warmup: int = 0):
        self.startup, self.warmup = startup, warmup

    def hopeless(self, means: list[float], past: list[list[float]]) -> bool:
        step = len(means) - 1
        others = [p[step] for p in past if len(p) > step and math.isfinite(p[step])]
        if len(past) < self.startup or step < self.warmup or not others:
            return False
        mine = [m for m in means if math.isfinite(m)]
        return not mine or max(mine) < float(np.median(others))


def run_folds(spark, score: Callable[[int], float], folds: int, threads: int, pruner: MedianPruner | None = None, past: list[list[float]] | None = None) -> tuple[list[float], bool]:
    """(scores of the folds, whether the trial was pruned). Up to `threads` folds run at the same time. A pruner sees the
    running means in order of the folds; once it gives up, the jobs of the folds that still run are cancelled by
    their group, and the scores are those of the folds it has seen."""
    group, stop = f"folds-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def run(fold: int) -> float:
        if stop.is_set():
            raise InterruptedError
        context.setJobGroup(group, f"fold {fold}")
        return score(fold)

    with ThreadPoolExecutor(max(1, min(folds, threads))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), f) for f in range(folds)]
        scores: list[float] = []
        means: list[float] = []
        try:
            for w in waiting:
                scores.append(w.result())
                means.append(float(np.mean(scores)))
                if pruner and len(scores) < folds and pruner.hopeless(means, past or []):
                    return scores, True
        finally:
            if len(scores) < folds:
                stop.set()
                for w in waiting:
                    w.cancel()
                context._jsc.sc().cancelJobGroupAndFutureJobs(group)
    return scores, False


class HPOEngine:
    """Draws trials, scores each on the folds of the training part, and fits the best again on that part.

    max_trees caps the trees of every model, and refit_trials fits each trial once more for the tracker: both change the
    cost only where they are set. pruner: ends hopeless trials early; without one every trial runs all folds."""

    def __init__(
        self,
        task_type: str = "classification",
        metric: str | None = None,
        n_trials: int = 50,
        cv_folds: int = 5,
        test_size: float = 0.2,
        random_state: int = 42,
        model_families: list[str] | None = None,
        tracker=None,
        sampler: RandomSampler | None = None,
        max_trees: int | None = None,
        refit_trials: bool = False,
        fold_threads: int = 4,
        pruner: MedianPruner | None = None,
    ):
        self.task_type, self.metric = task_type, metric or ("roc_auc" if task_type == "classification" else "r2")
        self.n_trials, self.cv_folds, self.test_size, self.random_state = n_trials, cv_folds, test_size, random_state
        self.model_families, self.tracker = model_families, tracker
        self.sampler = sampler or TPESampler(random_state)
        self.max_trees, self.refit_trials, self.fold_threads, self.pruner = max_trees, refit_trials, fold_threads, pruner
        if self.metric not in M.SCORERS:
            raise ValueError(f"unknown metric {self.metric!r}; there are {', '.join(M.SCORERS)}")
        self.trials: list[TrialResult] = []

    def available_model_families(self) -> list[str]:
        return models.available(self.model_families)

    def _suggest(self, families: list[str], history: list[tuple[str, dict, float]]) -> tuple[str, dict]:
        family = self.sampler.choose(families, [(f, s) for f, _, s in history])
        drawn = {}
        for name, spec in models.SPACES[family].items():
            drawn[name] = self.sampler.draw(spec, [(d[name], s) for f, d, s in history if f == family])
        return family, drawn

    def optimize(self, df: DataFrame, target: str, key: str, features: list[str] | None = None) -> HPOResult:
        """df: numeric features, the target, and a key that tells rows apart (splits are made by it)."""
        families = self.available_model_families()
        if not families:
            raise RuntimeError("No requested model family is available.")
        names = features or [c for c in df.columns if c not in (target, key)]
        classify = self.task_type == "classification"
        df = df.where(col(target).isNotNull())
        labels = models.Labels.of(df, target) if classify else None
        classes = len(labels.values) if classify else 0
        if classify and self.metric == "roc_auc" and classes > 2:
            self.metric = "roc_auc_ovr_weighted"
        y = (labels.encode(col(target)) if classify else col(target).cast("double")).alias("label")
        rows = df.select(col(key).alias("key"), y, *(col(n) for n in names))
        split = assemble(holdout(rows, "key", "label" if classes > 1 else None, self.test_size, self.random_state), names, ["key", "label", "is_test"]).persist()  # read by the counts and ranks of folds, too
        train = split.where(~F.col("is_test")).drop("is_test")
        test = split.where("is_test").drop("is_test")
        try:
            k = fold_count(train, "label", self.cv_folds) if classify else self.cv_folds
            train = assign_folds(train, "key", k, "label" if classify else None, self.random_state).persist()  # read by every fit
            history: list[tuple[str, dict, float]] = []
            past: list[list[float]] = []  # running means of whole trials
            for number in range(self.n_trials):
                family, drawn = self._suggest(families, history)
                params = models.resolved(family, drawn)
                estimator = models.build(family, params, self.task_type, classes, self.random_state, self.max_trees)
                scores, pruned = self._fold_scores(estimator, train, k, classes, past)
                mean, deviation = float(np.mean(scores)), float(np.std(scores))
                trial = TrialResult(number, family, params, mean, {"cv_mean": mean, "cv_std": deviation}, pruned)
                self.trials.append(trial)
                if not pruned:
                    past.append([float(np.mean(scores[: i + 1])) for i in range(len(scores))])
                if math.isfinite(mean) and not pruned:  # a trial without a score teaches the sampler nothing
                    history.append((family, drawn, mean))
                if self.tracker:
                    fitted = estimator.fit(train) if self.refit_trials and not pruned else None
                    self.tracker.log_trial(trial_number=number, model_family=family, params={"model_family": family, **params}, metrics=trial.metrics, model=fitted, feature_names=names, tags={"metric": self.metric, "state": "pruned" if pruned else "complete"})
            best = best_of(self.trials)
            model = models.build(best.model_family, best.params, self.task_type, classes, self.random_state, self.max_trees).fit(train)
            test_metrics = self.evaluate(model, test, classes)
            if self.tracker:
                self.tracker.log_best_model(model=model, model_family=best.model_family, params={"model_family": best.model_family, **best.params}, metrics={"best_cv_score": best.cv_score, **test_metrics})
        finally:
            train.unpersist()
            split.unpersist()
        return HPOResult(model, best.model_family, {"model_family": best.model_family, **best.params}, best.cv_score, self.metric, self.task_type, self.trials, names, labels, test_metrics)

    def _fold_scores(self, estimator, train: DataFrame, folds: int, classes: int, past: list[list[float]]) -> tuple[list[float], bool]:
        def score(fold: int) -> float:
            model = estimator.fit(train.where(F.col("fold") != fold))
            return self._score(model, train.where(F.col("fold") == fold), classes)

        return run_folds(train.sparkSession, score, folds, self.fold_threads, self.pruner, past)

    def _score(self, model, part: DataFrame, classes: int) -> float:
        out = models.predictions(model, part, classes).withColumn("y", F.col("label"))
        value = M.scored(out, self.metric, [float(i) for i in range(classes)])
        return float("nan") if value is None else float(value)

    def evaluate(self, model, test: DataFrame, classes: int) -> dict[str, float]:
        """Test metrics of a fitted model over (features, label)."""
        out = models.predictions(model, test, classes).withColumn("y", F.col("label"))
        if not classes:
            return M.regression_metrics(out).first().asDict()
        found = M.classification_metrics(out).first().asDict()
        if "scores" in out.columns and classes == 2 and out.select("y").distinct().count() == 2:
            found["test_roc_auc"] = M.roc_auc(out.select("y", F.get("scores", 1).alias("score")), 1.0).first()[0]
        return found


def trials_frame(spark, trials: list[TrialResult]) -> DataFrame:
    from ..functions.columns import flatten_params

    rows = [(t.trial_number, t.model_family, flatten_params(t.params), t.cv_score, t.metrics) for t in trials]
    return spark.createDataFrame(rows, "trial_number int, model_family string, params map<string,string>, cv_score double, metrics map<string,double>")
