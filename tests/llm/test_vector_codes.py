import hashlib
import math
import random

import numpy as np
import pytest

from quarrymill.llm import vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """Lloyd rounds in plain loops: {vec_id: (code, error, label_error)} and the digest. rows: (vec_id, vector, label)."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        owners = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, owners) if o[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    owners = assign()
    errors = [sum(d for d, _ in o) for o in owners]
    by = {}
    for (_, _, y), e in zip(kept, errors):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in o), e, by[y]) for (i, _, y), o, e in zip(kept, owners, errors)), digest


def run(spark, rows, partitions=3, schema="vec_id long, embedding array<double>, label int, code string, v int", **given):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(partitions)
    found = V.encode(df, label_col="label", **given)
    got = V.label_errors(found.rows).select("vec_id", "code", "error", "label_error").collect()
    return sorted(map(tuple, got)), found.sha256


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i * 3, [x + rng.gauss(0, 0.1 * spread) for x in rng.choice(centers)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_like_plain_loops(spark, rounds):
    rows = vectors(300, 32, rounds)
    assert run(spark, rows, rounds=rounds) == plain(rows, rounds=rounds)


def test_ties_copies_and_far_values(spark):
    rng = random.Random(5)
    grid = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(16)], 1) for i in range(200)]  # many equal distances and entries
    rows = grid + [(1000 + i, [0.25] * 16, 2) for i in range(150)] + [(2000, [1e30] * 16, None), (2001, [-1e30] * 16, None), (2002, [0.001] * 16, 2)]
    assert run(spark, rows, rounds=3) == plain(rows, rounds=3)
    assert run(spark, rows, partitions=1) == run(spark, rows, partitions=7)


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 20, 1)  # 20 components in 16 parts: zeros at the end
    bad = [(1, None, 1), (2, [], 1), (4, [None] * 20, 1), (5, [nan] * 20, 1), (7, [0.0] * 19 + [inf], 1), (8, [0.0] * 19 + [-inf], 1), (200, [0.0] * 7, 2)]
    assert run(spark, rows + bad) == plain(rows + bad)
    assert len(run(spark, rows + bad)[0]) == 40  # and fewer rows than entries
    assert run(spark, rows[:1] + bad) == plain(rows[:1] + bad)


def test_empty_and_repeated(spark):
    assert run(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, None, 1)])[0] == []
    rows = vectors(50, 16, 2)
    assert run(spark, rows + rows) == plain(rows + rows)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = vectors(400, 16, 3)
    want = plain(rows, rounds=4)
    monkeypatch.setattr(V, "BLOCK_BYTES", 1)  # 64 vectors a block
    assert run(spark, rows, rounds=4) == want


def test_label_errors_without_broadcast(spark):
    rows = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, 7, 5)], "vec_id long, label int, error long")
    for few in (0, 10):
        assert {r.vec_id: r.label_error for r in V.label_errors(rows, few).collect()} == {1: 5, 2: 5, 3: 5}


def test_heaps_save_scans_and_never_miss():
    """After a small move few parts are popped, and all owners are those of a full scan."""
    rng = np.random.default_rng(4)
    centers = rng.integers(-4000, 4000, (4, 8, 4))
    x = (centers[np.arange(4), rng.integers(0, 8, (500, 4))] + rng.integers(-60, 60, (500, 4, 4))).astype(np.int64)
    books = np.ascontiguousarray(x[:20].transpose(1, 0, 2))
    block, drift, scans = V.Block.first(x, books), np.zeros(books.shape[:2]), []
    for _ in range(6):
        new = books.copy()
        for p in range(4):
            for e in range(20):
                mine = x[block.codes[:, p] == e, p]
                if len(mine):
                    new[p, e] = mine.sum(0) // len(mine)
        drift += V.drifts(books, new)
        books = new
        block = V.Block.unpacked(500, V.Shape(16, 4, 20), *block.packed())
        scans.append(block.settle(books, drift))
        assert all((block.codes[:, p] == V.squares(x[:, p], books[p]).argmin(1)).all() for p in range(4))
    assert scans[-1] < 0.5 * 2000


def test_more_than_a_byte_of_entries(spark):
    rows = vectors(300, 4, 6)
    got, _ = run(spark, rows, parts=2, entries=290, rounds=1)
    assert all(len(code) == 8 for _, code, _, _ in got) and len({code[:4] for _, code, _, _ in got}) > 256
