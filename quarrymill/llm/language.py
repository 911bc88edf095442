"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (2 to 4, of its lower-cased letters; what stands between them is one blank),
weighted (1 + log count) times inverse document frequency, of length 1. Each language has several centroids, the clusters that
spherical k-means finds among its sample rows, since one language is written in several ways. A text gets the language
of the centroid with the largest cosine; its score is the softmax over the best cosines of the languages. A text is
rejected, as no language that was learned is near, if its best cosine lies under SLACK of what all but LOW of that
language's sample rows have. Their cosines for this are held out: each half is held against the other half's clusters.
A text of less than ENOUGH distinct n-grams says less: its limit falls with the root of their number.

The centroids come from a bounded sample of labelled rows, at most `per_language` of each of the `languages` most frequent
languages, those with the smallest hash of their id; every row is classified from its whole text. Rows of rarer languages
get another one or are rejected. Null texts and texts without a letter get `und`, score 0, and are rejected. If no language
can be learned, every text gets that. Of equal cosines the language first in order wins. Repeated rows count and are told as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, prepare

BITS, PER_LANGUAGE, CLUSTERS, SHARPNESS = 13, 400, 3, 25.0
MOST_LANGUAGES = 200
LOW, SLACK, ENOUGH = 0.01, 0.65, 200
BETWEEN = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of the n-grams."""
    g = np.frombuffer(f" {BETWEEN.sub(' ', text.lower()).strip()} ".encode(), "u1").astype("u8")
    found, a = [], g
    for n in range(2, 5):
        a = (a[:-1] << np.uint64(8)) | g[n - 1 :]
        if len(a) == 0:
            break
        found.append(((a + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    tally = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(tally)
    return at.astype(np.int32), tally[at].astype(np.int32)


def vectors(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(idf)), np.float32)
    for i, (at, n) in enumerate(rows):
        v = (1 + np.log(n)) * idf[at]
        out[i, at] = v / max(np.sqrt((v**2).sum()), 1e-12)
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length 1, each row's cosine with each): spherical k-means from rows drawn with a fixed seed. A
    cluster of a few rows is noise, not a way of writing: its rows go to the others."""
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    c = c[sizes >= min(sizes.max(), max(2, len(x) // 20))]
    return c, x @ c.T


def limit(x: np.ndarray, k: int, slack: float) -> float:
    """The cosine under which a text is none of the language with the rows x. One row has nothing to be held against: a
    quarter."""
    if len(x) < 2:
        return 0.25
    halves = x[::2], x[1::2]
    held_out = np.concatenate([(a @ cluster(b, k)[0].T).max(1) for a, b in (halves, halves[::-1])])
    return slack * float(np.quantile(held_out, LOW))


class Centroids:
    def __init__(self, sample: list[tuple[str, np.ndarray, np.ndarray]], bits: int = BITS, clusters: int = CLUSTERS, slack: float = SLACK):
        self.bits = bits
        df = np.zeros(1 << bits)
        for _, at, _ in sample:
            df[at] += 1
        self.idf = (np.log((1 + len(sample)) / (1 + df)) + 1).astype(np.float32)
        self.languages = sorted({s[0] for s in sample})
        centers, owner, radius = [], [], []
        for j, language in enumerate(self.languages):
            x = vectors([s[1:] for s in sample if s[0] == language], self.idf)
            c, _ = cluster(x, clusters)
            centers.extend(c)
            owner += [j] * len(c)
            radius += [limit(x, clusters, slack)] * len(c)
        self.centers, self.owner, self.radius = np.array(centers, np.float32), np.array(owner), np.array(radius)

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages or not at:
            return out
        for begin in range(0, len(at), 200):
            part = at[begin : begin + 200]
            tallied = [counts(texts[i], self.bits) for i in part]
            cosines = vectors(tallied, self.idf) @ self.centers.T
            best = np.stack([cosines[:, self.owner == j].max(1) for j in range(len(self.languages))], 1)
            e = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
            p = e.max(1) / e.sum(1)
            won, nearest = best.argmax(1), cosines.argmax(1)
            for n, i in enumerate(part):
                out[i] = self.languages[won[n]], float(min(p[n], 1.0)), bool(cosines[n, nearest[n]] < self.radius[nearest[n]] * min(1.0, len(tallied[n][0]) / ENOUGH) ** 0.5)
        return out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, clusters: int = CLUSTERS, languages: int = MOST_LANGUAGES) -> Centroids:
    """Centroids from the rows of docs (doc_id, text, lang) with text and lang. The rows of a language with the smallest
    hashes of their ids are found in one scan for all: counts say below which hash four times as many as needed lie."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    frequent = marked.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not frequent:
        return Centroids([], bits)
    most = [(r["lang"], -(1 << 63) + (min((1 << 64) - 1, (4 * per_language << 64) // r["count"]))) for r in frequent]
    limits = F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most long"))
    few = marked.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).join(limits, "lang").where("hash <= most").select("lang", "hash", "doc_id").distinct()
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))).where(F.col("place") <= per_language).select("doc_id", "lang")

    def features(batches):
        import pyarrow as pa

        for b in batches:
            kept = [(lang, *counts(t, bits)) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.string()), *(pa.array([r[i].tobytes() for r in kept], pa.binary()) for i in (1, 2))], names=["lang", "at", "n"])

    rows = marked.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang").mapInArrow(features, "lang string, at binary, n binary").collect()
    rows = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in rows)
    return Centroids([(lang, np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)) for lang, at, n in rows], bits, clusters)


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of docs."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = model.classify(b.column(1).to_pylist())
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prepare(spark)
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() would not reject, all columns as they are, without a shuffle."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([not rejected for _, _, rejected in model.classify(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
