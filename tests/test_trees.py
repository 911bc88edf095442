"""Histogram trees against plain loops over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import trees as R
from quarrymill.operators.features import assemble


def table(spark, x, y, partitions=3):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, label double, " + ", ".join(f"{n} double" for n in names))
    return assemble(df, names, ["key", "label"]).repartition(partitions)


def made(n, width, classes, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    score = x[:, 0] + x[:, 1] * x[:, -1] + rng.normal(0, 0.3, n)
    return x, np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)) if classes else score


def in_bins(df, x, bins):
    cuts = R.cut_points(df, "features", x.shape[1], bins)
    return cuts, np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)


def best_cut(b, rows, stats, gain, features, cuts, fits):
    """(gain, feature, bin) of the best cut of some rows, or None; the first of equal ones."""
    best = None
    for f in features:
        for at in range(len(cuts[f])):
            left, right = [r for r in rows if b[r, f] <= at], [r for r in rows if b[r, f] > at]
            if not left or not right or not fits(left, right):
                continue
            g = gain(stats[left].sum(0), stats[right].sum(0), stats[rows].sum(0))
            if g > 0 and (best is None or g > best[0]):
                best = (g, f, at, left, right)
    return best


def plain_tree(b, rows, stats, gain, value, features, cuts, fits, depth=None, leaves=None, may=lambda rows: True):
    """{path: (feature, bin) or value}: by level to a depth, or the leaf of the largest gain first."""
    find = lambda rows: best_cut(b, rows, stats, gain, features, cuts, fits) if may(rows) else None
    tree, open_ = {}, [("", rows, find(rows) if depth is None or depth > 0 else None)]
    ends = []
    while open_:
        if leaves:
            ready = [o for o in open_ if o[2]]
            if not ready or len(open_) + len(ends) >= leaves:
                break
            now = max(ready, key=lambda o: o[2][0])
        else:
            now = open_[0]
        open_ = [o for o in open_ if o is not now]
        path, rows, cut = now
        if not cut:
            ends.append(now)
            continue
        tree[path] = cut[1:3]
        for side, part in (("l", cut[3]), ("r", cut[4])):
            deeper = leaves or depth is None or len(path) + 1 < depth
            open_.append((path + side, part, find(part) if deeper else None))
    for path, rows, _ in open_ + ends:
        tree[path] = value(stats[rows].sum(0))
    return tree


def paths(tree, node=0, path=""):
    if tree.feature[node] < 0:
        return {path: tree.value[node]}
    out = {path: (tree.feature[node], tree.bin[node])}
    return out | paths(tree, tree.left[node], path + "l") | paths(tree, tree.right[node], path + "r")


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k]) and isinstance(a[k], tuple) == isinstance(b[k], tuple), (k, a[k], b[k])


def soft(g, alpha):
    return math.copysign(max(abs(g) - alpha, 0), g)


def plain_boost(spark, x, y, df, made_by):
    """The trees of a booster by plain loops, with the margins of all rows."""
    m = made_by
    kinds = m.classes if m.task == "classification" and m.classes > 2 else 1
    cuts, b = in_bins(df, x, m.bins)
    n = len(y)
    if m.task == "regression":
        start = np.array([y.mean()])
        quantum = 2.0**-24 * 2.0 ** math.ceil(math.log2(max(y.max() - y.mean(), y.mean() - y.min())))
    else:
        p = np.array([(y == k).mean() for k in range(kinds)]) if kinds > 1 else np.array([y.mean()])
        start, quantum = (np.log(p) if kinds > 1 else np.log(p / (1 - p))), 2.0**-24
    draw = np.array([r[0] for r in spark.range(n).orderBy("id").select(F.xxhash64("id")).collect()])
    margins = np.tile(start, (n, 1))
    out = []
    for number in range(m.trees):
        before = margins.copy()
        for k in range(kinds):
            stats = np.zeros((n, 3))
            for i in range(n):
                if m.task == "regression":
                    g, h = before[i, 0] - y[i], 1.0
                elif kinds == 1:
                    p = 1 / (1 + math.exp(-before[i, 0]))
                    g, h = p - y[i], p * (1 - p)
                else:
                    e = [math.exp(v - before[i].max()) for v in before[i]]
                    p = e[k] / sum(e)
                    g, h = p - (y[i] == k), 2 * p * (1 - p)
                stats[i] = round(g / quantum) * quantum, max(round(h * 2**24), 1) * 2.0**-24, 1
            rows = [i for i in range(n) if m.subsample == 1 or R.uniform(draw[i : i + 1], m.seed, number)[0] < m.subsample]
            part = lambda s: soft(s[0], m.alpha) ** 2 / (s[1] + m.l2)
            fits = lambda a, c: min(stats[a, 1].sum(), stats[c, 1].sum()) >= m.least_weight and min(len(a), len(c)) >= m.least_rows
            tree = plain_tree(b, rows, stats, lambda a, c, w: (part(a) + part(c) - part(w)) / 2, lambda s: -m.rate * soft(s[0], m.alpha) / (s[1] + m.l2), m.columns(x.shape[1], number), cuts, fits, m.depth, m.leaves)
            out.append(tree)
            for i in range(n):
                path = ""
                while isinstance(tree[path], tuple):
                    f, at = tree[path]
                    path += "l" if b[i, f] <= at else "r"
                margins[i, k] += tree[path]
    return out, margins


CASES = {
    "three classes": dict(classes=3, trees=3, depth=3),
    "two classes, L1, subsample, columns": dict(classes=2, trees=4, depth=3, alpha=0.7, subsample=0.7, column_share=0.5, rate=0.5),
    "regression, L1": dict(task="regression", trees=3, depth=4, alpha=2.0, l2=0.5, least_weight=5.0),
    "leaves, three classes": dict(classes=3, trees=2, depth=None, leaves=9, l2=0.0, least_weight=1e-3, least_rows=5),
    "leaves, regression": dict(task="regression", trees=2, depth=None, leaves=13, l2=0.0, least_weight=1e-3, least_rows=3, subsample=0.8),
}


@pytest.mark.parametrize("name", CASES)
def test_boosters_like_plain_loops(spark, name):
    booster = R.Booster(bins=12, **CASES[name])
    classes = booster.classes if booster.task == "classification" else 0
    x, y = made(240, 4, classes, 3)
    df = table(spark, x, y)
    model = booster.fit(df)
    want, margins = plain_boost(spark, x, y, df, booster)
    assert len(model.trees) == len(want)
    for got, tree in zip(model.trees, want):
        same(paths(got), tree)
    out = {r.key: r for r in model.transform(df).collect()}
    for i in range(len(y)):
        if not classes:
            assert abs(out[i].prediction - margins[i, 0]) < 1e-9
        else:
            p = np.exp(margins[i]) / np.exp(margins[i]).sum() if classes > 2 else np.array([1 - 1 / (1 + np.exp(-margins[i, 0])), 1 / (1 + np.exp(-margins[i, 0]))])
            assert np.allclose(out[i].probability.toArray(), p) and out[i].prediction == p.argmax()


def test_partitions_and_sizes_of_work_change_nothing(spark, monkeypatch):
    x, y = made(300, 3, 3, 5)
    booster = R.Booster(classes=3, trees=3, leaves=12, depth=None, least_rows=4, l2=0.0, least_weight=0.0, subsample=0.8, bins=16)
    want = [paths(t) for t in booster.fit(table(spark, x, y)).trees]
    monkeypatch.setattr(R, "AHEAD", 1)
    monkeypatch.setattr(R, "FOLD_IN", 1)
    assert [paths(t) for t in booster.fit(table(spark, x, y, 7)).trees] == want
    by_level = R.Booster(classes=3, trees=2, depth=4, bins=16)
    want = [paths(t) for t in by_level.fit(table(spark, x, y)).trees]
    monkeypatch.setattr(R, "BYTES", 1)  # a pass for each node
    assert [paths(t) for t in by_level.fit(table(spark, x, y, 1)).trees] == want


@pytest.mark.parametrize("name", ["forest", "forest of means, a depth", "levels", "leaves"])
def test_nodes_finished_apart_make_the_same_trees(spark, monkeypatch, name):
    """As passes alone, whichever nodes are small, in however many buckets; and a deep tree no longer takes a pass a level."""
    x, y = made(300, 4, 0 if "means" in name else 3, 13)
    learner = {
        "forest": R.Forest(classes=3, trees=3, at_once=3, least_to_split=12, bins=16),
        "forest of means, a depth": R.Forest(task="regression", trees=2, depth=5, least_rows=3, bins=16),
        "levels": R.Booster(classes=3, trees=1, depth=6, subsample=0.7, alpha=0.1, column_share=0.8, bins=16),
        "leaves": R.Booster(classes=3, trees=1, leaves=12, depth=None, least_rows=4, l2=0.0, least_weight=1e-3, subsample=0.8, bins=16),
    }[name]
    passes = []
    real = R._histograms
    monkeypatch.setattr(R, "_histograms", lambda *a: passes.append(1) or real(*a))
    grown, counts = [], []
    for small, bucket in ((0, 1 << 24), (1 << 17, 1 << 24), (60, 1 << 12)):
        monkeypatch.setattr(R, "FINISHED", small)
        monkeypatch.setattr(R, "BUCKET", bucket)
        passes.clear()
        model = learner.fit(table(spark, x, y))
        grown.append([(paths(t), {p: v for p, v in zip(_places(t), zip(t.threshold, t.gain, t.depth))}) for t in model.trees])
        counts.append(len(passes))
    assert all(g == grown[0] for g in grown[1:])
    assert counts[1] <= 4 and counts[1] < counts[2] <= counts[0]


def test_draws_of_many_nodes(spark):
    """Every set of features comes up alike, and siblings, parents and trees draw apart."""
    forest, paths = R.Forest(classes=3), np.array([1], np.uint64)
    for _ in range(13):
        paths = R.below(paths)
    draw = lambda tree, p: forest.columns(11, np.full(len(p), tree), p)
    drawn, after = draw(0, paths), draw(0, R.below(paths))
    assert len(set(paths.tolist())) == 1 << 13 and (np.diff(drawn) > 0).all() and drawn.shape[1] == 3
    assert abs(np.bincount(drawn.ravel()) / len(paths) - 3 / 11).max() < 0.03
    for a, b in ((drawn, draw(1, paths)), (after[::2], after[1::2]), (drawn, after[::2])):
        assert (a == b).all(1).mean() < 0.02  # 1 / 165 by chance


def _places(tree):
    """The path of each node, in order of their numbers."""
    out = {0: ""}
    for n, f in enumerate(tree.feature):
        if f >= 0:
            out[tree.left[n]], out[tree.right[n]] = out[n] + "l", out[n] + "r"
    return [out[n] for n in range(len(tree.feature))]


def test_leaves_are_obeyed(spark):
    x, y = made(900, 5, 2, 7)
    df = table(spark, x, y)
    for leaves in (2, 7, 31):
        model = R.Booster(trees=1, leaves=leaves, depth=None, l2=0.0, least_weight=0.0, least_rows=1).fit(df)
        assert model.trees[0].leaves == leaves
    fewer = R.Booster(trees=1, leaves=1000, depth=None, l2=0.0, least_rows=200).fit(df).trees[0]
    assert 1 < fewer.leaves <= 4


def test_the_smaller_child_is_summed_and_the_other_subtracted(spark, monkeypatch):
    """A leaf-wise tree asks rows for one child of each cut only."""
    x, y = made(200, 3, 0, 2)
    asked = []
    real = R._histograms
    monkeypatch.setattr(R, "_histograms", lambda rows, nodes, *a: asked.append(len(nodes)) or real(rows, nodes, *a))
    tree = R.Booster(task="regression", trees=1, leaves=9, depth=None, l2=0.0, least_rows=2).fit(table(spark, x, y)).trees[0]
    assert tree.leaves == 9 and asked[0] == 1 and asked[1] == 1 and all(b <= 2 * a for a, b in zip(asked[1:], asked[2:])) and len(asked) < 9


def test_l1_shrinks(spark):
    x, y = made(300, 4, 2, 1)
    df = table(spark, x, y)
    size = lambda a: sum(abs(v) for t in R.Booster(trees=3, depth=3, alpha=a).fit(df).trees for v, f in zip(t.value, t.feature) if f < 0)
    assert size(0.0) > size(2.0) > size(20.0) > 0 or size(20.0) == 0


def gini(a, c, w):
    part = lambda s: (s[:-1] ** 2).sum() / s[:-1].sum()
    return part(a) + part(c) - part(w) if part(a) + part(c) - part(w) > 1e-9 * part(w) else -1


@pytest.mark.parametrize("split, leaf, depth", [(2, 1, None), (20, 1, None), (2, 9, None), (31, 4, 3)])
def test_forest_like_plain_loops(spark, split, leaf, depth):
    x, y = made(200, 3, 3, 11)
    df = table(spark, x, y)
    forest = R.Forest(classes=3, trees=1, bootstrap=False, column_share=1.0, least_to_split=split, least_rows=leaf, depth=depth, bins=20)
    cuts, b = in_bins(df, x, 20)
    stats = np.stack([*((y == k).astype(float) for k in range(3)), np.ones(len(y))], 1)
    want = plain_tree(b, list(range(len(y))), stats, gini, lambda s: (s[:-1] / s[:-1].sum()).tolist(), range(3), cuts, lambda a, c: min(len(a), len(c)) >= leaf, depth, may=lambda rows: len(rows) >= split)
    same(paths(forest.fit(df).trees[0]), want)


def test_forest_deeper_than_thirty(spark):
    """Where labels alternate, each cut parts one end from the rest: a chain of 44 cuts."""
    x = np.arange(45.0)[:, None]
    df = table(spark, x, np.arange(45) % 2)
    model = R.Forest(classes=2, trees=1, bootstrap=False).fit(df)
    assert max(model.trees[0].depth) >= 40 and model.transform(df).where("prediction != label").count() == 0


def test_forest_draws(spark):
    """Bootstrap weights have mean one, features are drawn per node, and a forest of drawn trees predicts well."""
    x, y = made(1500, 4, 3, 9)
    df = table(spark, x, y)
    forest = R.Forest(classes=3, trees=12, at_once=5, least_rows=2)
    model = forest.fit(df)
    assert len(model.trees) == 12 and len({t.feature[0] for t in model.trees}) > 1
    out = model.transform(df)
    assert out.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.85
    u = np.concatenate([R.uniform(np.arange(4000), 1, t) for t in range(5)])
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:4000], u[4000:8000])[0, 1]) < 0.05


def test_saved_and_loaded(spark, tmp_path):
    x, y = made(200, 3, 3, 2)
    df = table(spark, x, y)
    from pyspark.ml.util import DefaultParamsReader

    for i, learner in enumerate((R.Booster(classes=3, trees=2, depth=3), R.Forest(classes=3, trees=3, depth=4), R.Booster(task="regression", trees=2, depth=2), R.Forest(task="regression", trees=2, depth=3))):
        model = learner.fit(df)
        path = f"file://{tmp_path}/m{i}"
        model.write().overwrite().save(path)
        again = DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)
        assert sorted(again.transform(df).collect()) == sorted(model.transform(df).collect())
        assert again.featureImportances == model.featureImportances and abs(sum(model.featureImportances) - 1) < 1e-9


def test_missing_constant_and_few_rows(spark):
    x = np.array([[1.0, 5.0, np.nan], [2.0, 5.0, 1.0], [3.0, 5.0, np.nan], [4.0, 5.0, 2.0]] * 10)
    y = np.array([0, 1, 0, 1] * 10)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, float(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))], "key long, label double, x array<double>")
    from pyspark.ml.functions import array_to_vector

    df = df.select("key", "label", array_to_vector("x").alias("features"))
    model = R.Booster(trees=2, depth=2, column_share=1.0).fit(df)
    assert model.featureImportances[1] == 0 and len(names) == model.width
    assert model.transform(df).where("prediction != label").count() == 0  # missing numbers go left
    one = R.Forest(classes=2, trees=2, bootstrap=False).fit(df.limit(1))
    assert [t.leaves for t in one.trees] == [1, 1] and one.transform(df.limit(1)).first().probability.sum() == 1
    with pytest.raises(ValueError, match="no rows"):
        R.Booster().fit(df.limit(0))
