"""Decision trees grown from histograms: second-order boosting, by level or by best leaf, and forests of any depth.

Rows are binned once into a table: a byte for each feature, beside the label, a number for draws, and the margins so far. A pass over
it measures nodes: every task routes its rows down the trees, adds up a histogram for each (node, feature), and hands
on one row for each; what belongs to a (node, feature) meets in one task, which finds its best bin; the best of
a node's features reaches the driver, one row a node. So a level of all trees that grow together is one job, whatever
the number of rows, features and classes, and no task or driver holds more than histograms (`BYTES` a task; a level with more nodes
takes several passes).

Leaf-wise growth pops the leaf with the largest gain until there are `leaves` of them. The children of the most promising `AHEAD` leaves are measured
in one pass; that order of work doesn't change the tree. Only the smaller child is summed from rows, its sibling is
the parent's stored histogram less the child's.

Passes are for large nodes. Below the root, nodes of up to `FINISHED` rows are finished apart: one shuffle deals their rows out, whole nodes to
buckets of about `BUCKET` bytes, and the task of a bucket grows their subtrees to the end. So a deep tree takes a pass for each level of large nodes and
one shuffle for all that lies below, and it is the tree that passes alone would make.

Sums don't depend on the order of rows: gradients are rounded to multiples of 2 ** -24 of their scale, which doubles add up
exactly. Of equal gains the lower feature wins, then the lower bin. Draws of rows hash the key column (or the row's place in the binned
table), so that a lost executor draws again what it drew. Missing numbers go left. Margins are added to the table every `FOLD_IN` rounds; in
between, a pass adds the newest trees itself.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, sent, stored

BINS, BYTES, AHEAD, FOLD_IN, QUANTUM = 64, 1 << 26, 64, 10, 2.0**-24
FINISHED, BUCKET = 1 << 20, 1 << 26
ROWS = "bins binary, y double, draw bigint, margins binary"


@dataclass
class Tree:
    """Nodes by number, 0 the root; feature -1 marks a leaf. value: one number, or one for each class."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list = field(default_factory=lambda: [None])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, at, threshold, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.value, None), (self.depth, self.depth[node] + 1)):
                column.append(x)
        return self.left[node], self.right[node]

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


class Routes:
    """A tree as arrays, for whole batches of rows at once."""

    def __init__(self, tree: Tree, binned: bool):
        self.feature = np.array(tree.feature, np.int32)
        self.cut = np.array(tree.bin if binned else tree.threshold)
        self.sides = np.array([tree.left, tree.right], np.int32)
        self.value = np.array(tree.value, float) if tree.value[0] is not None or len(tree.value) > 1 and all(v is not None for v in tree.value) else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (or the node that doesn't split yet)."""
        node = np.zeros(len(x), np.int32)
        at = np.arange(len(x)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(at):
            now = node[at]
            node[at] = self.sides[(x[at, self.feature[now]] > self.cut[now]).astype(np.int8), now]
            at = at[self.feature[node[at]] >= 0]
        return node


# Rows


def cut_points(df: DataFrame, features: str, width: int, bins: int) -> list[list[float]]:
    """Each feature's inner bounds, midway between neighbours of its distinct quantiles: one aggregate for all features."""
    shares = [i / (bins - 1) for i in range(bins)]
    values = df.select(F.posexplode(vector_to_array(features)).alias("f", "x")).where(~F.isnan("x"))
    found = values.groupBy("f").agg(F.percentile_approx("x", shares, 10_000).alias("q")).collect()  # bins numbers a feature
    cuts: list[list[float]] = [[] for _ in range(width)]
    for r in found:
        q = sorted(set(r.q))
        cuts[r.f] = [a + (b - a) / 2 for a, b in zip(q, q[1:])]
    return cuts


def binned(df: DataFrame, features: str, label: str, key: str | None, cuts: list[list[float]], start: np.ndarray) -> DataFrame:
    edges = [np.array(c) for c in cuts]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges))
            out = np.zeros((n, len(edges)), np.uint8)
            for f, e in enumerate(edges):
                out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], "left"))
            raw = [r.tobytes() for r in out]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), b.column(1), b.column(2), pa.array([start.tobytes()] * n, pa.binary())], names=["bins", "y", "draw", "margins"])

    draw = F.xxhash64(F.col(key)) if key else F.xxhash64(F.monotonically_increasing_id())
    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), draw.alias("draw")).mapInArrow(run, ROWS)


def _matrix(column, kind: str, n: int) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    start, end = column.offset, column.offset + len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[start : end + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(n, -1)


def uniform(draw: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) for each row and `number`, from the row's hash."""
    salt = (seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    x = draw.view(np.uint64) ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) * 2.0**-53


def below(paths: np.ndarray) -> np.ndarray:
    """The numbers of both children of each path, in pairs; a path is a 64-bit number, 1 the root's."""
    return (paths[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.array([[1, 2]], np.uint64)).reshape(-1)


# Statistics of a node, and the gain of a cut


@dataclass
class SecondOrder:
    """Sums of gradient, hessian and rows. alpha: soft threshold on gradients."""

    l2: float = 1.0
    alpha: float = 0.0
    least_weight: float = 1.0
    least_rows: int = 1
    size = 3

    def _part(self, s: np.ndarray) -> np.ndarray:
        g = np.sign(s[..., 0]) * np.maximum(np.abs(s[..., 0]) - self.alpha, 0.0)
        return g * g / np.maximum(s[..., 1] + self.l2, 1e-16)

    def gains(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        right = whole - left
        fits = (np.minimum(left[..., 1], right[..., 1]) >= self.least_weight) & (np.minimum(left[..., 2], right[..., 2]) >= self.least_rows)
        return np.where(fits, (self._part(left) + self._part(right) - self._part(whole)) / 2, -np.inf)

    def values(self, s: np.ndarray) -> list[float]:
        g = np.copysign(np.maximum(np.abs(s[:, 0]) - self.alpha, 0.0), s[:, 0])
        return (-g / np.maximum(s[:, 1] + self.l2, 1e-16)).tolist()

    def may_split(self, s: np.ndarray) -> np.ndarray:
        return s[..., -1] >= max(2, 2 * self.least_rows)


@dataclass
class Impurity:
    """Weighted sums of each class (or weight and value, for regression), and rows. The gain is the decrease of Gini
    impurity, or of variance, times the weight."""

    classes: int
    least_rows: int = 1
    least_to_split: int = 2

    @property
    def size(self) -> int:
        return (self.classes or 2) + 1

    def _part(self, s: np.ndarray) -> np.ndarray:
        if self.classes:
            c = s[..., :-1]
            return (c * c).sum(-1) / np.maximum(c.sum(-1), 1e-16)
        return s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-16)

    def gains(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        right = whole - left
        fits = (np.minimum(left[..., -1], right[..., -1]) >= max(1, self.least_rows)) & (whole[..., -1] >= self.least_to_split)
        gain = self._part(left) + self._part(right) - self._part(whole)
        return np.where(fits & (gain > 1e-9 * np.abs(self._part(whole))), gain, -np.inf)

    def values(self, s: np.ndarray) -> list:
        if self.classes:
            return (s[:, :-1] / np.maximum(s[:, :-1].sum(1, keepdims=True), 1e-16)).tolist()
        return (s[:, 1] / np.maximum(s[:, 0], 1e-16)).tolist()

    def may_split(self, s: np.ndarray) -> np.ndarray:
        pure = (s[..., :-1] != 0).sum(-1) <= 1 if self.classes else False
        return (s[..., -1] >= max(2, 2 * self.least_rows, self.least_to_split)) & ~np.asarray(pure)


# Passes


@dataclass
class Asked:
    """A node to measure: of which tree, and by which features."""

    tree: int
    node: int
    features: np.ndarray


@dataclass
class Found:
    """A node's best cut (feature -1: none) and its sums."""

    feature: int
    bin: int
    gain: float
    left: np.ndarray
    whole: np.ndarray


def _histograms(rows: DataFrame, asked: list[Asked], trees: list[Tree], statistics: Callable, size: int, width: int, bins: int) -> DataFrame:
    """(slot, feature, cells) of each task's rows. statistics(y, draw, margins, bins) yields for each tree (weights (n,
    size), which rows count)."""
    routes = [Routes(t, True) for t in trees]
    slots = [np.full(len(t.feature), -1, np.int64) for t in trees]
    wanted = np.zeros((len(asked), width), bool)
    for s, a in enumerate(asked):
        slots[a.tree][a.node] = s
        wanted[s, a.features] = True
    of_tree = [[s for s, a in enumerate(asked) if a.tree == t] for t in range(len(trees))]
    used = [np.flatnonzero(wanted[s].any(0)) if s else np.zeros(0, np.int64) for s in of_tree]
    full = [bool(wanted[s][:, u].all()) for s, u in zip(of_tree, used)]

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(asked), width, bins, size))
        for b in batches:
            n = b.num_rows
            x = _matrix(b.column(0), "u1", n)
            margins = _matrix(b.column(3), "<f8", n) if len(b.column(3)[0].as_py()) else np.zeros((n, 0))
            y, draw = b.column(1).to_numpy(), b.column(2).to_numpy()
            for t, (weights, counts) in enumerate(statistics(y, draw, margins, x)):
                if not len(used[t]):
                    continue
                slot = slots[t][routes[t](x)]
                at = np.flatnonzero((slot >= 0) & counts)
                for f in used[t]:
                    here = at if full[t] else at[wanted[slot[at], f]]
                    cell = slot[here] * bins + x[here, f]
                    for k in range(size):
                        if len(here) * 4 > len(asked) * bins:
                            total[:, f, :, k] += np.bincount(cell, weights[here, k], len(asked) * bins).reshape(len(asked), bins)
                        else:
                            np.add.at(total[:, f, :, k], (slot[here], x[here, f]), weights[here, k])
        seen = total.any((2, 3)) & wanted
        s, f = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(f, pa.int32()), pa.array([total[i, j].tobytes() for i, j in zip(s, f)], pa.binary())], names=["slot", "feature", "cells"])

    return rows.mapInArrow(run, "slot int, feature int, cells binary")


FOUND = "slot int, feature int, gain double, bin int, left binary, whole binary"


def _best(total: np.ndarray, rule) -> tuple[float, int, np.ndarray, np.ndarray]:
    """(gain, bin, sums left of it, all sums) of one histogram (bins, size)."""
    left = total.cumsum(0)
    gains = rule.gains(left[:-1], left[-1])
    at = int(gains.argmax()) if len(gains) else 0
    return float(gains[at]) if len(gains) else -math.inf, at, left[at], left[-1]


def _combined(cells: DataFrame, rule, bins: int, parts: int) -> DataFrame:
    """The sums and the best cut of each (slot, feature)."""

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for s, f, raw in zip(*(c.to_pylist() for c in b.columns)):
                new = np.frombuffer(raw)
                sums[s, f] = sums[s, f] + new if (s, f) in sums else new
        out = [(s, f, *_best(total.reshape(bins, -1), rule)) for (s, f), total in sums.items()]
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), *(pa.array([v.tobytes() for v in columns[i]], pa.binary()) for i in (4, 5))], names=["slot", "feature", "gain", "bin", "left", "whole"])

    return cells.repartition(parts, "slot", "feature").mapInArrow(run, FOUND)


def _split(cells: DataFrame, rule, bins: int, parts: int, siblings: dict[int, int]) -> DataFrame:
    """As _combined, for children: rows of kind 1 are their parents' stored sums, and each slot's sibling gets what the parent
    has beside it. The sums go along, for the children's children."""

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for s, f, raw, kind in zip(*(c.to_pylist() for c in b.columns)):
                both = sums.setdefault((s, f), [None, None])
                new = np.frombuffer(raw)
                both[kind] = new if both[kind] is None else both[kind] + new
        out = []
        for (s, f), (own, parent) in sums.items():
            own = np.zeros_like(parent) if own is None else own
            for slot, total in ((s, own), *(((siblings[s], parent - own),) if s in siblings else ())):
                out.append((slot, f, *_best(total.reshape(bins, -1), rule), total))
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), *(pa.array([v.tobytes() for v in columns[i]], pa.binary()) for i in (4, 5, 6))], names=["slot", "feature", "gain", "bin", "left", "whole", "cells"])

    return cells.repartition(parts, "slot", "feature").mapInArrow(run, FOUND + ", cells binary")


def _chosen(found: DataFrame) -> dict[int, Found]:
    """The best cut of each slot: one row a node."""
    best = F.max_by(F.struct("feature", "bin", "gain", "left", "whole"), F.struct("gain", -F.col("feature")))
    out = {}
    for r in found.groupBy("slot").agg(best.alias("b")).collect():
        ok = r.b.gain > 0
        out[r.slot] = Found(r.b.feature if ok else -1, r.b.bin, r.b.gain, np.frombuffer(bytes(r.b.left)), np.frombuffer(bytes(r.b.whole)))
    return out


# Subtrees of nodes whose rows fit a task


@dataclass
class Held:
    """A node to finish apart. path: its place in the tree (see Grower.by_level). room: levels, or cuts, that may follow."""

    tree: int
    node: int
    path: int
    room: int | None
    rows: int


@dataclass
class Grown:
    """A subtree as arrays, node 0 its root, children after their parents. Each node's best cut (feature -1: none), its first
    child (the second is the next; 0: not cut) and its sums. left: sums left of the cut, where they are asked for."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    gain: np.ndarray
    whole: np.ndarray
    left: np.ndarray

    KINDS = {"feature": "<i4", "bin": "u1", "child": "<i4", "gain": "<f8", "whole": "<f8", "left": "<f8"}

    def raw(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in self.KINDS.items()]

    @classmethod
    def of(cls, raw: dict, size: int) -> Grown:
        arrays = {k: np.frombuffer(bytes(raw[k]), kind) for k, kind in cls.KINDS.items()}
        return cls(**{k: v.reshape(-1, size) if k in ("whole", "left") else v for k, v in arrays.items()})


def _grown_by_level(x: np.ndarray, weights: list[np.ndarray], root: np.ndarray, held: list[Held], rule, bins: int, features: Callable) -> list[Grown]:
    """The subtrees of all roots, grown together a level at a time. root: each row's place in held."""
    size, step = len(weights), max(1, BYTES // (80 * bins * len(weights)))
    order = np.argsort(root, kind="stable")
    n = len(held)
    feature, cut, child, gain, of = [np.full(n, -1, np.int32)], [np.zeros(n, np.uint8)], [np.zeros(n, np.int32)], [np.zeros(n)], [np.arange(n)]
    whole = [np.stack([np.bincount(root, w, n) for w in weights], 1)]
    total, node = n, root[order]  # all nodes so far; the open node of each row that is still in one
    at, sums, paths, levels = np.arange(n), whole[0], np.array([h.path for h in held], np.uint64), np.array([-1 if h.room is None else h.room for h in held])
    tree = np.array([h.tree for h in held])
    while len(at):
        m = len(at)
        drawn = features(tree[_picked(of, at)], paths)
        best, where, cuts, left = np.full(m, -np.inf), np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros((m, size))
        for low in range(0, m, step):
            high = min(m, low + step)
            first, last = np.searchsorted(node, (low, high))
            rows, own = order[first:last], node[first:last] - low
            mine = [w[rows] for w in weights]
            for j in range(drawn.shape[1]):
                key = own * bins + x[rows, drawn[low:high, j][own]]
                upto = np.stack([np.bincount(key, w, (high - low) * bins).reshape(-1, bins) for w in mine], 2).cumsum(1)
                gains = rule.gains(upto[:, :-1], upto[:, -1:])
                top = gains.argmax(1)
                found = gains[np.arange(high - low), top]
                better = np.flatnonzero(found > best[low:high])
                best[low + better], where[low + better], cuts[low + better], left[low + better] = found[better], drawn[low + better, j], top[better], upto[better, top[better]]
        split = np.flatnonzero(best > 0)
        firsts = total + 2 * np.arange(len(split), dtype=np.int64)
        _put(feature, at[split], where[split])
        _put(cut, at[split], cuts[split])
        _put(child, at[split], firsts)
        _put(gain, at[split], best[split])
        both = np.stack([left[split], sums[split] - left[split]], 1).reshape(-1, size)
        roots = np.repeat(_picked(of, at[split]), 2)
        k = len(both)
        for column, new in ((feature, np.full(k, -1, np.int32)), (cut, np.zeros(k, np.uint8)), (child, np.zeros(k, np.int32)), (gain, np.zeros(k)), (of, roots), (whole, both)):
            column.append(new)
        deeper = np.repeat(levels[split] - 1, 2)  # of no limit: below zero, and stays so
        goes_on = np.flatnonzero(rule.may_split(both) & (deeper != 0))
        after = np.full(m * 2, -1, np.int64)  # (open node, side) -> the next level's open node
        place = np.full(k, -1, np.int64)
        place[goes_on] = np.arange(len(goes_on))
        after.reshape(m, 2)[split] = place.reshape(-1, 2)
        side = x[order, np.maximum(where, 0)[node]] > cuts[node]
        node = after[node * 2 + side]
        order, node = order[node >= 0], node[node >= 0]
        sort = np.argsort(node.astype(np.uint16) if len(goes_on) < 1 << 16 else node, kind="stable")  # 16 bits are sorted by radix
        order, node = order[sort], node[sort]
        paths, levels = below(paths[split])[goes_on], deeper[goes_on]
        at, sums = total + goes_on, both[goes_on]
        total += k
    feature, cut, child, gain, of, whole = (np.concatenate(c) for c in (feature, cut, child, gain, of, whole))
    sort = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[sort], np.arange(n + 1))
    local = np.empty(total, np.int32)
    local[sort] = np.arange(total) - ends[of[sort]]
    child = np.where(child > 0, local[child], 0)
    parts = [sort[a:b] for a, b in zip(ends, ends[1:])]
    return [Grown(feature[i], cut[i], child[i], gain[i], whole[i], np.zeros((0, size))) for i in parts]


def _picked(column: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Values of open nodes: they all lie in the last piece of a column, or in the first if that is all there is."""
    return column[-1][at - sum(map(len, column[:-1]))]


def _put(column: list[np.ndarray], at: np.ndarray, values: np.ndarray) -> None:
    column[-1][at - sum(map(len, column[:-1]))] = values


def _grown_by_leaf(x: np.ndarray, weights: list[np.ndarray], held: Held, rule, bins: int, features: np.ndarray) -> Grown:
    """The subtree of one root whose leaf with the largest gain is cut first, up to `room` times."""
    size = len(weights)

    def summed(rows):
        mine = [w[rows] for w in weights]
        return np.stack([np.stack([np.bincount(x[rows, f], w, bins) for w in mine], 1) for f in features])

    def best(cells):
        upto = cells.cumsum(1)
        gains = rule.gains(upto[:, :-1], upto[:, -1:])
        f, at = divmod(int(gains.argmax()), bins - 1)
        ok = gains[f, at] > 0
        return features[f] if ok else -1, at, gains[f, at], upto[f, at], upto[f, -1]

    rows, cells = [np.arange(len(x))], [summed(np.arange(len(x)))]
    found, child = [best(cells[0])], [0]
    queue = [(-found[0][2], 0)] if found[0][0] >= 0 else []
    cuts = 0
    while queue and cuts < held.room:
        _, n = heapq.heappop(queue)
        f, at, _, left, whole = found[n]
        right = x[rows[n], f] > at
        parts = rows[n][~right], rows[n][right]
        small = int((whole - left)[-1] < left[-1])
        own = summed(parts[small])
        both = (own, cells[n] - own) if not small else (cells[n] - own, own)
        child[n], rows[n], cells[n] = len(found), None, None
        cuts += 1
        for part, total in zip(parts, both):
            found.append(best(total))
            if found[-1][0] >= 0:
                heapq.heappush(queue, (-found[-1][2], len(child)))
            child.append(0), rows.append(part), cells.append(total)
    columns = [np.array(c) for c in zip(*found)]
    return Grown(columns[0], columns[1], np.array(child), columns[2], columns[4].reshape(-1, size), columns[3].reshape(-1, size))


def _dealt(rows: DataFrame, held: list[Held], bucket: np.ndarray, trees: list[Tree], statistics: Callable) -> DataFrame:
    """(bucket, slots, bins, weights) of each batch's rows in held nodes, as bytes."""
    routes = [Routes(t, True) for t in trees]
    slots = [np.full(len(t.feature), -1, np.int64) for t in trees]
    for s, h in enumerate(held):
        slots[h.tree][h.node] = s
    needed = [bool((s >= 0).any()) for s in slots]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            x = _matrix(b.column(0), "u1", n)
            margins = _matrix(b.column(3), "<f8", n) if len(b.column(3)[0].as_py()) else np.zeros((n, 0))
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for t, (weights, counts) in enumerate(statistics(b.column(1).to_numpy(), b.column(2).to_numpy(), margins, x)):
                if needed[t]:
                    slot = slots[t][routes[t](x)]
                    at = np.flatnonzero((slot >= 0) & counts)
                    parts.append((slot[at], at, weights[at]))
            slot, at, weights = (np.concatenate(c) for c in zip(*parts))
            to = bucket[slot]
            order = np.argsort(to, kind="stable")
            ids, starts = np.unique(to[order], return_index=True)
            cut = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), *(pa.array([np.ascontiguousarray(made(o)).tobytes() for o in cut], pa.binary()) for made in (lambda o: slot[o].astype("<i4"), lambda o: x[at[o]], lambda o: weights[o].astype("<f8")))], names=["bucket", "slots", "bins", "weights"]
            )

    return rows.mapInArrow(run, "bucket int, slots binary, bins binary, weights binary")


def finished(rows: DataFrame, held: list[Held], trees: list[Tree], statistics: Callable, rule, bins: int, width: int, features: Callable, by_leaf: bool) -> list[Grown]:
    """The subtrees of held nodes: their rows are dealt out once, whole nodes to tasks, largest first to the emptiest bucket."""
    each = width + 8 * rule.size + 4
    n = max(-(-sum(h.rows for h in held) * each // BUCKET), min(len(held), rows.sparkSession.sparkContext.defaultParallelism))
    loads, bucket = [(0, i) for i in range(n)], np.zeros(len(held), np.int64)
    for s in sorted(range(len(held)), key=lambda s: -held[s].rows):
        load, i = loads[0]
        bucket[s] = i
        heapq.heapreplace(loads, (load + held[s].rows, i))
    size = rule.size

    def run(batches):
        import pyarrow as pa

        columns = list(zip(*((c.to_pylist() for c in b.columns[1:]) for b in batches)))
        if not columns:
            return
        slots, x, weights = (np.frombuffer(b"".join(v for c in column for v in c), kind) for column, kind in zip(columns, ("<i4", "u1", "<f8")))
        x, weights = x.reshape(-1, width), [np.ascontiguousarray(w) for w in weights.reshape(-1, size).T]
        present, root = np.unique(slots, return_inverse=True)
        mine = [held[s] for s in present]
        if by_leaf:
            order = np.argsort(root, kind="stable")
            parts = np.split(order, np.searchsorted(root[order], np.arange(1, len(mine))))
            out = [_grown_by_leaf(x[p], [w[p] for w in weights], h, rule, bins, features(np.array([h.tree]), np.array([h.path], np.uint64))[0]) for h, p in zip(mine, parts)]
        else:
            out = _grown_by_level(x, weights, root, mine, rule, bins, features)
        for s, g in zip(present, out):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([v], pa.binary()) for v in g.raw())], names=["slot", *Grown.KINDS])

    found = _dealt(rows, held, bucket, trees, statistics).repartitionById(n, F.col("bucket")).mapInArrow(run, "slot int, " + ", ".join(f"{k} binary" for k in Grown.KINDS))
    got = {r.slot: Grown.of(r.asDict(), size) for r in found.collect()}  # the model's own size
    return [got[s] for s in range(len(held))]


@dataclass
class Grower:
    """What all growth has in common. rows: the binned table."""

    rows: DataFrame
    cuts: list[list[float]]
    rule: object
    bins: int

    @property
    def width(self) -> int:
        return len(self.cuts)

    def _parts(self, nodes: int) -> int:
        return max(1, min(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes * self.width // 8))

    @property
    def most(self) -> int:
        """How many nodes a pass may measure."""
        return max(1, BYTES // (8 * self.width * self.bins * self.rule.size))

    def _pieces(self, asked: list[Asked]) -> Iterator[list[Asked]]:
        most = self.most
        return (asked[i : i + most] for i in range(0, len(asked), most))

    def measure(self, asked: list[Asked], trees: list[Tree], statistics: Callable) -> list[Found | None]:
        out: list[Found | None] = []
        for piece in self._pieces(asked):
            cells = _histograms(self.rows, piece, trees, statistics, self.rule.size, self.width, self.bins)
            got = _chosen(_combined(cells, self.rule, self.bins, self._parts(len(piece))))
            out += [got.get(s) for s in range(len(piece))]
        return out

    @property
    def small(self) -> int:
        """Up to how many rows a node is finished apart."""
        return min(FINISHED, BUCKET // (self.width + 8 * self.rule.size + 4))

    def cut(self, tree: Tree, node: int, found: Found) -> tuple[int, int]:
        sides = tree.split(node, found.feature, found.bin, self.cuts[found.feature][found.bin], found.gain)
        tree.value[sides[0]], tree.value[sides[1]] = self.rule.values(np.stack([found.left, found.whole - found.left]))
        return sides

    def by_level(self, trees: list[Tree], statistics: Callable, features: Callable[[np.ndarray, np.ndarray], np.ndarray], depth: int | None) -> None:
        """All trees grow together, a level at a time; small nodes wait until all large ones are cut. A node whose sums can't split
        is not measured again. features(trees, paths): a row of features for each node, whose path `below` makes from its parent's."""
        frontier, held = [(t, 0, 1) for t in range(len(trees))], []
        level = 0
        while frontier and (depth is None or level < depth):
            at, _, paths = zip(*frontier)
            drawn = features(np.array(at), np.array(paths, np.uint64))
            found = self.measure([Asked(t, n, f) for (t, n, _), f in zip(frontier, drawn)], trees, statistics)
            after = []
            level += 1
            for (t, n, p), f in zip(frontier, found):
                if f is None:
                    continue
                if n == 0:
                    trees[t].value[0] = self.rule.values(f.whole[None])[0]
                if f.feature >= 0:
                    sides = self.cut(trees[t], n, f)
                    for side, path, sums in zip(sides, below(np.array([p], np.uint64)).tolist(), (f.left, f.whole - f.left)):
                        if self.rule.may_split(sums) and (depth is None or level < depth):
                            if sums[-1] > self.small:
                                after.append((t, side, path))
                            else:
                                held.append(Held(t, side, path, None if depth is None else depth - level, int(sums[-1])))
            frontier = after
        if held:
            for h, g in zip(held, finished(self.rows, held, trees, statistics, self.rule, self.bins, self.width, features, False)):
                self._graft(trees[h.tree], h.node, g)

    def _graft(self, tree: Tree, node: int, g: Grown) -> None:
        """Puts a subtree in the place of a leaf, whose value stays."""
        base = len(tree.feature) - 1
        thresholds = [self.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(g.feature.tolist(), g.bin.tolist())]
        left = np.where(g.child > 0, g.child + base, 0)
        depth = np.zeros(len(g.child), np.int64)
        for i in np.flatnonzero(g.child):
            depth[g.child[i] : g.child[i] + 2] = depth[i] + 1
        columns = (tree.feature, g.feature.tolist()), (tree.bin, g.bin.tolist()), (tree.threshold, thresholds), (tree.left, left.tolist()), (tree.right, np.where(left > 0, left + 1, 0).tolist()), (tree.gain, g.gain.tolist())
        for column, new in columns:
            column[node] = new[0]
            column += new[1:]
        tree.value += self.rule.values(g.whole)[1:]
        tree.depth += (depth[1:] + tree.depth[node]).tolist()

    def by_leaf(self, trees: list[Tree], statistics: Callable, features: Callable[[np.ndarray, np.ndarray], np.ndarray], leaves: int) -> int:
        """Each tree pops its leaf with the largest gain (of equal ones the older) until it has `leaves` leaves. The number
        of passes."""
        spark = self.rows.sparkSession
        known: dict[tuple[int, int], Found] = {}
        where: dict[tuple[int, int], tuple[str, int]] = {}  # a node's stored sums: table and slot
        tables: dict[str, DataFrame] = {}
        queues: list[list[tuple[float, int]]] = [[] for _ in trees]
        ghosts: dict[tuple[int, int], tuple[int, int]] = {}  # children made ahead of their turn
        shadow = [Tree() for _ in trees]  # the trees with those children
        passes = 0

        def run(ask: list[tuple[int, int]], siblings: dict[int, int], slots: dict[tuple[int, int], int], parents: dict[int, tuple[int, int]]) -> None:
            nonlocal passes
            passes += 1
            cells = _histograms(self.rows, [Asked(t, n, f) for (t, n), f in zip(ask, features(*map(np.array, zip(*ask))))], shadow, statistics, self.rule.size, self.width, self.bins).withColumn("kind", F.lit(0))
            by_table: dict[str, list[tuple[int, int]]] = {}
            for slot, parent in parents.items():
                path, there = where[parent]
                by_table.setdefault(path, []).append((there, slot))
            for path, pairs in by_table.items():
                to = F.create_map(*(F.lit(v) for pair in pairs for v in pair))
                old = tables[path].where(F.col("slot").isin([a for a, _ in pairs])).select(to[F.col("slot")].alias("slot"), "feature", "cells", F.lit(1).alias("kind"))
                cells = cells.unionByName(old)
            table, path = _split(cells, self.rule, self.bins, self._parts(len(ask)), siblings), ""
            if not parents or any(known[p].whole[-1] > apart for p in parents.values()):  # children may be cut by passes, too
                table, path = stored(table, "leaf-sums")
                tables[path] = table
            got = _chosen(table.drop("cells"))
            for key, slot in slots.items():
                where[key] = (path, slot)
                if slot in got:
                    known[key] = got[slot]

        roots = [(t, 0) for t in range(len(trees))]
        run(roots, {}, {k: i for i, k in enumerate(roots)}, {})
        for t, _ in roots:
            if (t, 0) in known:
                trees[t].value[0] = self.rule.values(known[t, 0].whole[None])[0]
                if known[t, 0].feature >= 0:
                    heapq.heappush(queues[t], (-known[t, 0].gain, 0))
        names = [{0: 0} for _ in trees]  # nodes of the tree -> nodes of its shadow
        apart = self.small if leaves * self.width * self.bins * self.rule.size * 8 <= BYTES else 0  # a subtree's sums are held at once
        while any(q and trees[t].leaves < leaves for t, q in enumerate(queues)):
            # Measure the children of the best leaves of each tree, as far as they may be popped.
            ask, siblings, slots, parents, held = [], {}, {}, {}, []
            for t, q in enumerate(queues):
                open_ = [n for _, n in heapq.nsmallest(min(AHEAD, max(1, self.most // len(trees)), leaves - trees[t].leaves), q)]
                for n in open_:
                    s = names[t][n]
                    if (t, s) in ghosts:
                        continue
                    f = known[t, s]
                    if s and f.whole[-1] <= apart:
                        held.append(Held(t, s, s, leaves - trees[t].leaves, int(f.whole[-1])))
                        continue
                    pair = shadow[t].split(s, f.feature, f.bin, 0.0, f.gain)
                    ghosts[t, s] = pair
                    sums = (f.left, f.whole - f.left)
                    small = int(sums[1][-1] < sums[0][-1])
                    slot = len(ask)
                    ask.append((t, pair[small]))
                    slots[t, pair[small]] = slot
                    parents[slot] = (t, s)
            for slot, (t, n) in enumerate(ask):
                a, b = ghosts[parents[slot]]
                other = b if n == a else a
                siblings[slot] = len(ask) + slot
                slots[t, other] = len(ask) + slot
            if ask:
                run(ask, siblings, slots, parents)
            if held:
                passes += 1
                for h, g in zip(held, finished(self.rows, held, shadow, statistics, self.rule, self.bins, self.width, features, True)):
                    twins = {0: h.node}
                    for i, c in enumerate(g.child.tolist()):
                        if c:
                            ghosts[h.tree, twins[i]] = pair = shadow[h.tree].split(twins[i], int(g.feature[i]), int(g.bin[i]), 0.0, float(g.gain[i]))
                            twins[c], twins[c + 1] = pair
                        if i:
                            known[h.tree, twins[i]] = Found(int(g.feature[i]), int(g.bin[i]), float(g.gain[i]), g.left[i], g.whole[i])
            for t, q in enumerate(queues):
                while q and trees[t].leaves < leaves and (t, names[t][q[0][1]]) in ghosts:
                    _, n = heapq.heappop(q)
                    s = names[t][n]
                    sides = self.cut(trees[t], n, known[t, s])
                    for side, twin in zip(sides, ghosts[t, s]):
                        names[t][side] = twin
                        f = known.get((t, twin))
                        if f is not None and f.feature >= 0:
                            heapq.heappush(q, (-f.gain, side))
        discard(spark, *tables)
        return passes


# Learners


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(task: str, y: np.ndarray, margins: np.ndarray, quantum: float) -> Iterator[np.ndarray]:
    """(n, 3) of gradient, hessian and one for each class (once for two classes and for regression), rounded to multiples
    of quantum. margins: (n, classes or 1)."""
    kinds = margins.shape[1]
    if task == "regression":
        pairs = [(margins[:, 0] - y, np.ones(len(y)))]
    elif kinds == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        pairs = [(p - y, p * (1 - p))]
    else:
        p = _softmax(margins)
        pairs = [(p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])) for k in range(kinds)]
    for g, h in pairs:
        yield np.stack([np.rint(g / quantum) * quantum, np.maximum(np.rint(h / QUANTUM), 1) * QUANTUM, np.ones(len(y))], 1)


@dataclass
class Booster:
    """Second-order boosting over (features, label). leaves: leaf-wise growth to so many leaves; else trees grow by level to
    `depth`. One tree a class and round, under the softmax loss, for more than two classes."""

    task: str = "classification"
    classes: int = 2
    trees: int = 100
    depth: int | None = 6
    leaves: int | None = None
    rate: float = 0.3
    subsample: float = 1.0
    column_share: float = 1.0
    l2: float = 1.0
    alpha: float = 0.0
    least_weight: float = 1.0
    least_rows: int = 1
    bins: int = BINS
    seed: int = 42
    features_col: str = "features"
    label_col: str = "label"
    key_col: str = "key"

    def columns(self, width: int, number: int) -> np.ndarray:
        """The features that a round's tree may use."""
        n = max(1, int(self.column_share * width))
        return np.arange(width) if n == width else np.sort(np.random.default_rng([self.seed, number]).permutation(width)[:n])

    def fit(self, df: DataFrame) -> TreesModel:
        kinds = self.classes if self.task == "classification" and self.classes > 2 else 1
        label = F.col(self.label_col).cast("double")
        got = df.agg(F.count(label), F.avg(label), F.min(label), F.max(label), *(F.avg((label == k).cast("double")) for k in range(kinds if kinds > 1 else 0))).first()
        if not got[0]:
            raise ValueError("there are no rows to learn from")
        width = len(df.select(vector_to_array(self.features_col).alias("x")).first().x)
        if self.task == "regression":
            start, span = np.array([got[1]]), max(got[3] - got[1], got[1] - got[2], 1e-300)
            quantum = QUANTUM * 2.0 ** math.ceil(math.log2(span))
        else:
            p = np.clip([got[1]] if kinds == 1 else got[4:], 1e-6, 1 - 1e-6)
            start, quantum = np.log(p / (1 - p)) if kinds == 1 else np.log(p), QUANTUM
        cuts = cut_points(df, self.features_col, width, self.bins)
        key = self.key_col if self.key_col in df.columns else None
        rows, path = stored(binned(df, self.features_col, self.label_col, key, cuts, start.astype("<f8")), "binned")
        grower = Grower(rows, cuts, SecondOrder(self.l2, self.alpha, self.least_weight, self.least_rows), self.bins)
        done: list[Tree] = []
        folded = 0
        for number in range(self.trees):
            new = [Tree() for _ in range(kinds)]
            recent = self._adder(done[folded:], kinds)
            task, share, seed = self.task, self.subsample, self.seed

            def statistics(y, draw, margins, x, recent=recent, number=number):
                counts = uniform(draw, seed, number) < share if share < 1 else np.ones(len(y), bool)
                for weights in gradients(task, y, recent(margins, x), quantum):
                    yield weights, counts

            chosen = self.columns(width, number)
            if self.leaves:
                grower.by_leaf(new, statistics, lambda t, p: np.tile(chosen, (len(t), 1)), self.leaves)
            else:
                grower.by_level(new, statistics, lambda t, p: np.tile(chosen, (len(t), 1)), self.depth)
            for t in new:
                t.value = [self.rate * (v or 0.0) for v in t.value]
            done += new
            if (number + 1) % FOLD_IN == 0 and number + 1 < self.trees:
                grower.rows, now = stored(self._folded(grower.rows, self._adder(done[folded:], kinds)), "binned")
                discard(df.sparkSession, path)
                path, folded = now, len(done)
        discard(df.sparkSession, path)
        return TreesModel(done, self.task, self.classes if self.task == "classification" else 0, kinds, start.tolist(), width, False)

    @staticmethod
    def _adder(trees: list[Tree], kinds: int) -> Callable:
        routes = [Routes(t, True) for t in trees]

        def add(margins, x):
            margins = margins.copy()
            for i, r in enumerate(routes):
                margins[:, i % kinds] += r.value[r(x)]
            return margins

        return add

    @staticmethod
    def _folded(rows: DataFrame, add: Callable) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                x, margins = _matrix(b.column(0), "u1", b.num_rows), _matrix(b.column(3), "<f8", b.num_rows)
                raw = [m.tobytes() for m in np.ascontiguousarray(add(margins, x))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary())], names=b.schema.names)

        return rows.mapInArrow(run, ROWS)


@dataclass
class Forest:
    """A random forest over (features, label): rows drawn with replacement for each tree (Poisson counts), a random part
    of the features for each node, leaves' class shares (or means) averaged over trees. depth None: until nothing splits."""

    task: str = "classification"
    classes: int = 2
    trees: int = 100
    depth: int | None = None
    least_to_split: int = 2
    least_rows: int = 1
    at_once: int = 16
    bootstrap: bool = True
    column_share: float | None = None
    bins: int = BINS
    seed: int = 42
    features_col: str = "features"
    label_col: str = "label"
    key_col: str = "key"

    def columns(self, width: int, trees: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """The features that each node may use: the square root of their number for classification, else all."""
        n = max(1, int(self.column_share * width)) if self.column_share else max(1, int(math.sqrt(width))) if self.task == "classification" else width
        if n >= width:
            return np.tile(np.arange(width), (len(trees), 1))
        draw = (paths * np.uint64(0xBF58476D1CE4E5B9) + trees.astype(np.uint64) * np.uint64(0x94D049BB133111EB))[:, None] + np.arange(width, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return np.sort(np.argsort(uniform(draw, self.seed, 0), 1, kind="stable")[:, :n], 1)

    def fit(self, df: DataFrame) -> TreesModel:
        first = df.select(vector_to_array(self.features_col).alias("x")).first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        width = len(first.x)
        classes = self.classes if self.task == "classification" else 0
        quantum = QUANTUM
        if not classes:
            span = df.agg(F.max(F.abs(F.col(self.label_col).cast("double")))).first()[0] or 1.0
            quantum = QUANTUM * 2.0 ** math.ceil(math.log2(max(span, 1e-300)))
        cuts = cut_points(df, self.features_col, width, self.bins)
        key = self.key_col if self.key_col in df.columns else None
        rows, path = stored(binned(df, self.features_col, self.label_col, key, cuts, np.zeros(0)), "binned")
        grower = Grower(rows, cuts, Impurity(classes, self.least_rows, self.least_to_split), self.bins)
        done: list[Tree] = []
        for base in range(0, self.trees, self.at_once):
            new = [Tree() for _ in range(min(self.at_once, self.trees - base))]
            grower.by_level(new, self._statistics(classes, quantum, base, len(new)), lambda t, p, base=base: self.columns(width, base + t, p), self.depth)
            done += new
        discard(df.sparkSession, path)
        for t in done:
            t.value = [([1.0 / classes] * classes if classes else 0.0) if v is None else v for v in t.value]
        return TreesModel(done, self.task, classes, max(1, classes), [0.0] * max(1, classes), width, True)

    def _statistics(self, classes: int, quantum: float, base: int, n: int) -> Callable:
        bootstrap, seed = self.bootstrap, self.seed
        steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])

        def statistics(y, draw, margins, x):
            for t in range(n):
                w = np.searchsorted(steps, uniform(draw, seed, base + t), "right").astype(float) if bootstrap else np.ones(len(y))
                parts = [(y == k) * w for k in range(classes)] if classes else [w, np.rint(y / quantum) * quantum * w]
                yield np.stack([*parts, (w > 0).astype(float)], 1), w > 0

        return statistics


def feature_cuts(df: DataFrame, names: list[str], label: str, classes: int = 0, bins: int = 256, l2: float = 1.0) -> DataFrame:
    """(feature, threshold, gain) of each feature's best cut of all rows, as the root of a forest's tree sees it (classes > 0:
    label counts from 0), or of the first regression tree of a booster. Features without a cut are left out."""
    from .features import assemble

    vectors = assemble(df, names, [label])
    cuts = cut_points(vectors, "features", len(names), bins)
    rule, quantum, mean = Impurity(classes) if classes else SecondOrder(l2), QUANTUM, 0.0
    if not classes:
        y = F.col(label).cast("double")
        mean, span = df.agg(F.avg(y), F.max(y) - F.min(y)).first()
        quantum = QUANTUM * 2.0 ** math.ceil(math.log2(span or 1.0))
    rows = binned(vectors, "features", label, None, cuts, np.zeros(0))

    def statistics(y, draw, margins, x):
        one = np.ones(len(y))
        parts = [(y == k).astype(float) for k in range(classes)] if classes else [np.rint((mean - y) / quantum) * quantum, one]
        yield np.stack([*parts, one], 1), one > 0

    cells = _histograms(rows, [Asked(0, 0, np.arange(len(names)))], [Tree()], statistics, rule.size, len(names), bins)
    found = _combined(cells, rule, bins, Grower(rows, cuts, rule, bins)._parts(1)).where("gain > 0")
    edges = F.array(*(F.array(*map(F.lit, c)).cast("array<double>") for c in cuts))
    return found.select(F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature"), F.get(F.get(edges, F.col("feature")), F.col("bin")).alias("threshold"), "gain")


class TreesModel(Model, MLWritable, MLReadable):
    """Fitted trees: adds `prediction`, and `probability` for classification, to rows with `features`."""

    def __init__(self, trees: list[Tree] | None = None, task: str = "classification", classes: int = 2, kinds: int = 1, start: list[float] | None = None, width: int = 0, averaged: bool = False):
        super().__init__()
        self.trees, self.task, self.classes, self.kinds, self.start, self.width, self.averaged = trees or [], task, classes, kinds, start or [0.0], width, averaged

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of all gain."""
        total = np.zeros(self.width)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        return DenseVector(total / total.sum() if total.sum() else total)

    def scores(self) -> Callable[[np.ndarray], np.ndarray]:
        """From (n, width) features to class shares, or predictions (n, 1)."""
        routes = [Routes(t, False) for t in self.trees]
        task, classes, kinds, start, averaged = self.task, self.classes, self.kinds, np.array(self.start), self.averaged

        def run(x: np.ndarray) -> np.ndarray:
            out = np.tile(start, (len(x), 1))
            for i, r in enumerate(routes):
                if averaged:
                    out += r.value[r(x)].reshape(len(x), -1) / len(routes)
                else:
                    out[:, i % kinds] += r.value[r(x)]
            if task == "regression" or averaged:
                return out
            if kinds == 1:
                up = 1 / (1 + np.exp(-out))
                return np.hstack([1 - up, up])
            return _softmax(out)

        return run

    def _transform(self, df: DataFrame) -> DataFrame:
        scores = self.scores()

        width = self.width

        @F.arrow_udf("array<double>")
        def scored(x):
            import pyarrow as pa

            flat = x.flatten().to_numpy(zero_copy_only=False)  # the batch's numbers, uncopied
            made = scores(flat.reshape(len(x), width)) if len(x) else np.zeros((0, 1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))

        out = df.withColumn("__scores", scored(vector_to_array("features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.get("__scores", 0)).drop("__scores")
        top = F.array_position("__scores", F.array_max("__scores")).cast("double") - 1
        return out.withColumn("prediction", top).withColumn("probability", array_to_vector("__scores")).drop("__scores")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_COLUMNS = "tree int, node int, feature int, bin int, threshold double, left int, right int, gain double, depth int, value array<double>"


class _Writer(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        spark = self.sparkSession
        about = {"task": m.task, "classes": m.classes, "kinds": m.kinds, "start": m.start, "width": m.width, "averaged": m.averaged, "trees": len(m.trees)}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"trees": json.dumps(about)})
        listed = lambda v: list(v) if isinstance(v, list) else [float(v or 0.0)]
        rows = [(i, n, t.feature[n], t.bin[n], float(t.threshold[n]), t.left[n], t.right[n], float(t.gain[n]), t.depth[n], listed(t.value[n])) for i, t in enumerate(m.trees) for n in range(len(t.feature))]
        sent(spark, rows, _COLUMNS).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> TreesModel:
        spark = self.sparkSession
        about = json.loads(DefaultParamsReader.loadMetadata(path, spark)["trees"])
        trees = [Tree([], [], [], [], [], [], [], []) for _ in range(about.pop("trees"))]
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():  # the model's own size
            t = trees[r.tree]
            value = list(r.value) if about["averaged"] and about["classes"] else r.value[0]
            for column, x in ((t.feature, r.feature), (t.bin, r.bin), (t.threshold, r.threshold), (t.left, r.left), (t.right, r.right), (t.gain, r.gain), (t.depth, r.depth), (t.value, value)):
                column.append(x)
        return TreesModel(trees, **about)
