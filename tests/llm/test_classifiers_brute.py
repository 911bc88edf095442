"""The classifiers' scores, told again by plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import language, quality


def brute_counts(text):
    raw = f" {re.sub(r'[\W\d_]+', ' ', text.lower()).strip()} ".encode()
    grams = [(n, int.from_bytes(raw[i : i + n], "big")) for n in (2, 3, 4) for i in range(len(raw) - n + 1)]
    return Counter(((g + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.BITS) for n, g in grams)


def test_language_like_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("hash")).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.hash, r.doc_id)):
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            by[r.lang].append(r.text)
    sample = [brute_counts(t) for texts in by.values() for t in texts[: language.PER_LANGUAGE] if any(c.isalpha() for c in t)]
    df = Counter(g for c in sample for g in c)
    idf = lambda g: math.log((1 + len(sample)) / (1 + df[g])) + 1
    model = language.learn(table.where(~language.held_out()))
    assert model.languages == sorted(by)
    got = {r.doc_id: r for r in language.op8(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        v = {g: (1 + math.log(n)) * idf(g) for g, n in brute_counts(r.text).items()}
        at, x = np.array(list(v)), np.array(list(v.values()))
        cosines = model.centers[:, at].astype(float) @ x / math.sqrt((x**2).sum())
        best = [cosines[model.owner == j].max() for j in range(len(model.languages))]
        score = 1 / sum(math.exp(language.SHARPNESS * (b - max(best))) for b in best)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-3)
        assert best[model.languages.index(got[r.doc_id].lang_pred)] == pytest.approx(max(best), abs=1e-5)


def test_dual_descent_like_brute_force():
    r = np.random.default_rng(11)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(40)]
    values, costs = r.normal(size=12), np.full(40, 0.3)
    signs = np.where(r.random(40) < 0.5, 1.0, -1.0)
    x = np.ones((40, 13))  # the last column is the bias
    for i, own in enumerate(rows):
        x[i, :12] = np.where(np.isin(np.arange(12), own), values, 0.0)
    q = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(100_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, costs)
    loss = lambda w: 0.5 * w @ w + (costs * np.maximum(0, 1 - signs * (x @ w))).sum()
    w, b = quality._descend(rows, values, signs, costs, epochs=2000)
    assert loss(np.array([*w, b])) == pytest.approx(loss((alpha * signs) @ x), rel=1e-2)


def test_quality_like_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    assert max(Counter(labels.values()).values()) <= quality.PER_CLASS  # so that the sample is all of them
    sample = sorted((quality.indicators(docs[i]).tobytes(), y) for i, y in labels.items() if i in docs)
    order = np.random.default_rng(1).permutation(len(sample))
    weights, offset = quality.fit([np.frombuffer(sample[i][0], np.int32) for i in order], np.array([sample[i][1] for i in order]), sum(labels.values()) / len(labels))
    got = {r.doc_id: r.score for r in quality.op10(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weights[j] for j in quality.indicators(text).tolist()) - offset)), abs=1e-6)


def test_long_words_have_whole_shapes():
    long = "aB3" * 20
    assert quality._shape(f"{long}-".encode()) != quality._shape(f"{long}+".encode())
