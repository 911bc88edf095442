"""Quality scores: a linear support vector machine over naive-Bayes features.

Every text gives a set of n-grams: byte n-grams of 1 to 4 of the case-kept text, n-grams of 1 to 3 of the shapes of its
words (case, digits, signs, "as the word before"), and the same shapes with the share of the words they make up, in
powers of two. The n-grams are hashed into `2 ** bits` indicators. An indicator's value is its log-count ratio between
the classes; on these a hinge-loss model is fitted by dual coordinate descent, and its margin is turned into a
probability by a logistic curve fitted on folds that the model has not seen.

The model is fitted on the driver from a bounded sample of labelled rows: at most `per_class` of each class, those with
the smallest hash of their id. Every row is scored from its whole text. Null texts count as empty and get a score too.
Without rows of both classes every score is the share of the class that there is (0.5 without any).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare, texts

BITS, PER_CLASS, CUT = 16, 1500, 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


_SHAPE = bytes.maketrans(bytes(range(256)), bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
))
_SHAPES: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    """A number for the word's case, digits and signs, without its length."""
    found = _SHAPES.get(word)
    if found is None:
        runs, last = bytearray(), -1
        for c in word.translate(_SHAPE):
            if c != last:
                runs.append(c)
                last = c
        found = zlib.crc32(bytes(runs))
        if len(word) <= 24:
            if len(_SHAPES) > 200_000:
                _SHAPES.clear()
            _SHAPES[word] = found
    return found


def indicators(text: str, bits: int = BITS) -> np.ndarray:
    """The sorted numbers of the n-grams in text."""
    raw = text.encode()
    seen = np.zeros(1 << bits, bool)
    g = np.frombuffer(raw, "u1").astype("u8")
    a = g
    for n in range(1, 5):
        if len(a) == 0:
            break
        seen[_mixed(a + np.uint64(n << 40), bits)] = True
        a = (a[:-1] << np.uint64(8)) | g[n:]
    words = raw.split()
    if words:
        shapes = np.array([_shape(w) for w in words], "u8")
        same = np.array([False, *(a == b for a, b in zip(words, words[1:]))])
        shapes[same] = 1
        a = shapes
        for n in range(1, 4):
            seen[_mixed(a + np.uint64((16 + n) << 40), bits)] = True
            a = a[:-1] * np.uint64(31) + shapes[n:]
            if len(a) == 0:
                break
        kinds, counts = np.unique(shapes, return_counts=True)
        share = np.floor(np.log2(counts / len(words))).astype("i8").astype("u8") & np.uint64(63)
        seen[_mixed(kinds * np.uint64(64) + share + np.uint64(32 << 40), bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the likeliest logistic curve, by Newton's method with a weak pull of the slope towards 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - labels) * margins).sum() + 0.1 * (a - 1), (p - labels).sum()])
        h = np.array([[(w * margins**2).sum() + 0.1, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _descend(rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, costs: np.ndarray, epochs: int = 30, seed: int = 7):
    """(weights, bias) of the hinge-loss model: dual coordinate descent, one row's multiplier at a time."""
    weights, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([(values[r] ** 2).sum() + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            gradient = signs[i] * ((weights[x] * values[x]).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if (change := (new - alpha[i]) * signs[i]) != 0:
                weights[x] += change * values[x]
                bias += change
                most = max(most, abs(change) * norms[i] ** 0.5)
                alpha[i] = new
        if most < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, bits: int = BITS, cost: float = 0.05, smooth: float = 1.0, folds: int = 3):
    """(weights per indicator, offset): the score of a text is the logistic of the sum of its weights plus offset.
    prior: the share of label 1 among all labelled rows, of which the sample may hold another share."""
    signs = np.where(labels == 1, 1.0, -1.0)
    if len(rows) == 0 or abs(signs.sum()) == len(rows):
        share = 0.5 if len(rows) == 0 else float(labels[0])
        return np.zeros(1 << bits), float(np.log((share + 1e-6) / (1 - share + 1e-6)))

    def model(keep):
        counts = np.full((2, 1 << bits), smooth)
        for i in keep:
            counts[int(labels[i]), rows[i]] += 1
        share = counts / np.array([[(labels[keep] == k).sum() + 2 * smooth] for k in (0, 1)])
        ratio = np.log(share[1] / share[0])
        ratio[counts.sum(0) <= 2 * smooth + 1] = 0.0  # seen once at most
        balance = [len(keep) / (2 * max(1, (labels[keep] == k).sum())) for k in (0, 1)]
        w, b = _descend([rows[i] for i in keep], ratio, signs[keep], cost * np.where(labels[keep] == 1, balance[1], balance[0]))
        return w * ratio, b

    part = np.arange(len(rows)) % folds
    margins = np.empty(len(rows))
    for k in range(folds):
        w, b = model(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            margins[i] = w[rows[i]].sum() + b
    slope, offset = _logistic(margins, labels.astype(float))
    w, b = model(np.arange(len(rows)))
    here = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(here / (1 - here)) if 0 < prior < 1 else 0.0
    return slope * w, float(slope * b + offset + shift)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """((text, label) of at most per_class rows of each class, the share of label 1 among all rows of labels)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    n, ones = marked.agg(F.count(F.lit(1)), F.sum("label")).first()
    chosen = [marked.where(F.col("label") == k).groupBy("doc_id").agg(F.first("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = chosen[0].union(chosen[1])  # bounded, so it may be broadcast
    return docs.join(F.broadcast(sample), "doc_id").select("text", "label"), (ones or 0) / n if n else 0.5


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs; labels: the (doc_id, label) rows that may be learned from."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)

    def features(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([indicators(t, bits).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["found", "label"])

    chosen, prior = training_rows(rows, labels, label, per_class)
    sample = sorted((bytes(r.found), r.label) for r in chosen.mapInArrow(features, "found binary, label int").collect())
    order = np.random.default_rng(1).permutation(len(sample))
    weights, offset = fit([np.frombuffer(sample[i][0], np.int32) for i in order], np.array([sample[i][1] for i in order]), prior, bits)
    del sample

    def run(batches):
        import pyarrow as pa

        for b in batches:
            margins = np.array([weights[indicators(t, bits)].sum() for t in b.column(1).to_pylist()]) + offset
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -60, 60))), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part != 0)
    found = score(documents(spark, sf_dir), labels)
    return found.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
