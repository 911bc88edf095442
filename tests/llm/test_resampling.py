import hashlib
import math
import random
import re
import zlib

import pytest
from helpers import NASTY, frame

from quarrymill.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5):
    """{(doc_id, n_features, weight, score, rank)} in plain loops."""
    s, t = [0] * 10000, [0] * 10000
    for texts, counts in ((docs, s), (target, t)):
        for _, x in texts:
            for b in grams(x)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    out = []
    for i, x in docs:
        w, g = grams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in g)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


def run(docs, target, **given):
    return sorted(tuple(r) for r in R.resample(docs, target, **given).select("doc_id", "n_features", "weight", "score", "rank").collect())


def some(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["Alpha", "beta", "γάμμα", "d-e", "x" * 90, "7", "zeta", "Ärger"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_like_plain_loops(spark, percent):
    docs, target = some(300, 1) + [(1000 + i, t) for i, t in NASTY], some(40, 2) + [(900, None), (901, "")]
    assert run(frame(spark, docs), frame(spark, target), percent=percent) == plain(docs, target, percent)


def test_empty_tables(spark):
    docs, target = some(60, 3), some(10, 4)
    assert run(frame(spark, []), frame(spark, target)) == []
    assert run(frame(spark, docs), frame(spark, [])) == plain(docs, [])
    assert run(frame(spark, [(1, None), (2, "")]), frame(spark, [])) == plain([(1, None), (2, "")], [])


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(None, text), (5, text), (5, text), (6, "short")]
    got = {(r[0], r[4]) for r in R.resample(frame(spark, docs), frame(spark, []), percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect()}
    empty, five = R.noise(None), R.noise(5)
    assert got == ({(None, 1), (5, 2), (5, 3), (6, None)} if empty > five else {(5, 1), (5, 2), (None, 3), (6, None)})


def test_runs_of_any_size_give_the_same(monkeypatch):
    texts = [t if t is None else t.encode() for _, t in NASTY + some(20, 6)]
    count = lambda: sorted((n, int(o), int(b)) for n, own, found in R.features(texts) for o, b in zip(own, found))
    want = count()
    assert [(o, b) for _, o, b in want] and sorted(b for _, _, b in want) == sorted(b for t in texts for b in grams(None if t is None else t.decode())[1])
    monkeypatch.setattr(R, "CHUNK", 7)
    monkeypatch.setattr(R, "PIECE", 50)
    assert count() == want


@pytest.mark.parametrize("digit", [1, 3, 12])
def test_radix_selection(spark, digit):
    rng = random.Random(digit)
    ends = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    rows = [(rng.choice([*ends, *range(-50, 50)]), rng.choice([*ends, *range(20)])) for _ in range(120)] + [(4, 4)] * 9
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(3)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 17, 60, len(rows) - 1, len(rows)):
        last = order[k - 1]
        want = sorted(r for r in rows if (-r[1], r[0]) <= (-last[1], last[0]))
        assert sorted(tuple(r) for r in df.where(R.up_to_kth(df, k, digit)).collect()) == want


def test_one_score_for_all(spark):
    df = spark.createDataFrame([(i, 30, 5, 0, 8) for i in range(500)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    got = {r.doc_id: r["rank"] for r in R.ranked(df, 37).collect()}
    assert got == {i: i + 1 if i < 37 else None for i in range(500)}
