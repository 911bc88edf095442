"""Canonical exact fingerprints of documents.

A text is brought to its canonical form (NFKC, case folding, NFKC again, white space folded to single blanks); its
fingerprint is a 128-bit xxHash of that form. Inside equal buckets the canonical bytes are compared: per digest the
least and greatest (losslessly packed) canonical texts, combined in each task first, so that a hot bucket reaches a
reducer as one pair a task. Edited texts, which exist only where two documents meet, are compared with each other and with
the documents by the SHA-256 of their canonical forms. If a digest is found under different texts, its fingerprints get
that SHA-256 appended, so equal fingerprints mean equal canonical texts, in both columns.

`successors` gives each document the next one in ascending doc_id without sorting everything into one task: split
points are identifiers that occur, rows go straight to the partition of their range, and the first row of each range
is sent to the range before it as well.

Null texts count as empty. Repeated doc_ids are ordered by text and each has the next row as its successor. An empty
table gives no rows; the only document is its own successor.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, prepare, release, texts

MAX_RANGES = 20_000


def canonical(text: str) -> bytes:
    """The canonical form as UTF-8. Case folding can undo normalisation, hence the second pass."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(form: bytes, bits: int = 128) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(form)[: bits // 8]


def splits(rows: DataFrame, chars_per_range: int) -> list[int]:
    """First doc_ids of ranges with about as many rows each, in ascending order; each of them occurs in rows."""
    total, least = rows.agg(F.sum(F.char_length("text")), F.min("doc_id")).first()
    if least is None:
        return []
    n = min(MAX_RANGES, int(total or 0) // chars_per_range + 1)
    cut = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    return sorted({least, *cut})


def successors(rows: DataFrame, chars_per_range: int = 4_000_000) -> tuple[DataFrame, int]:
    """(range, borrowed, doc_id, packed text), each range in one partition, in order: borrowed rows come last and only
    say what follows the range's own last row. Texts are packed with Zstandard for the exchange."""
    first = splits(rows, chars_per_range)
    n = max(1, len(first))

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        cut, packer = np.array(first, dtype="i8"), zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0).to_numpy()
            packed = [packer.compress(t.encode()) for t in b.column(1).to_pylist()]
            at = np.maximum(np.searchsorted(cut, ids, side="right") - 1, 0)
            lent = np.flatnonzero(cut[at] == ids)
            every = np.concatenate([np.arange(len(ids)), lent])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([at, (at[lent] - 1) % n]), pa.int32()),
                    pa.array(np.repeat([False, True], [len(ids), len(lent)])),
                    pa.array(ids[every]),
                    pa.array([packed[i] for i in every], pa.binary()),
                ],
                names=["range", "borrowed", "doc_id", "packed"],
            )

    dealt = rows.mapInArrow(deal, "range int, borrowed boolean, doc_id long, packed binary")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("borrowed", "doc_id", "packed"), n


def in_order(batches) -> Iterator[tuple[tuple[int, str], tuple[int, str]]]:
    """(row, next row) for each own row of a partition that successors() made."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    before = None
    for b in batches:
        for borrowed, doc_id, packed in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            row = (doc_id, unpack(packed).decode())
            if before is not None:
                yield before, row
            before = None if borrowed else row


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def collisions(rows: DataFrame, bits: int) -> DataFrame:
    """Digests that different canonical texts share."""

    def forms(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            found = [canonical(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(f, bits) for f in found], pa.binary()), pa.array([packer.compress(f) for f in found], pa.binary())], names=["digest", "form"])

    buckets = rows.select("text").mapInArrow(forms, "digest binary, form binary")
    return buckets.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least != most").select("digest")


def fingerprints(docs: DataFrame, bits: int = 128, chars_per_range: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each document, of its edited text, and their likeness: 1.0 for the same canonical text, else
    0.0, since an exact fingerprint knows no degrees. bits: fewer make more collisions, never another grouping."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=list(RAW))

        out, last = [], (None, b"")
        for (doc_id, text), (next_id, following) in in_order(batches):
            form = last[1] if last[0] == (doc_id, text) else canonical(text)
            after, changed = canonical(following), edited(text, following)
            last = ((next_id, following), after)
            changed_form = canonical(changed)
            out.append((
                doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(form, bits), hashlib.sha256(form).digest(),
                digest(changed_form, bits), hashlib.sha256(changed_form).digest(), float(form == changed_form), float(form == after),
            ))
            if len(out) == 1000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    KINDS = [getattr(pa_types(), k)() for k in ("int64", "int64", "string", "binary", "binary", "binary", "binary", "float64", "float64")]
    clashing = materialize(collisions(rows, bits), "fingerprint-clashing")
    ordered, _ = successors(rows, chars_per_range)
    release(docs.sparkSession)  # the first exchange of the texts; Spark lets go of a job's files only after the next job, here that of the ranges
    found = materialize(ordered.mapInArrow(run, RAW_SCHEMA), "fingerprint-rows")
    each = found.select(F.col("d").alias("digest"), F.col("d_sha").alias("sha")).unionByName(found.select(F.col("e").alias("digest"), F.col("e_sha").alias("sha")))
    unlike = each.groupBy("digest").agg(F.min("sha").alias("least"), F.max("sha").alias("most")).where("least != most").select("digest")
    collided = materialize(clashing.unionByName(unlike).distinct(), "fingerprint-collided")
    if collided.isEmpty():
        found = found.withColumns({"fingerprint": F.lower(F.hex("d")), "edited_fingerprint": F.lower(F.hex("e"))})
    else:
        for key, wide, name in (("d", "d_sha", "fingerprint"), ("e", "e_sha", "edited_fingerprint")):
            found = found.join(collided.select(F.col("digest").alias(key), F.lit(True).alias("clash")), key, "left")
            found = found.withColumn(name, F.lower(F.concat(F.hex(key), F.when(F.col("clash"), F.hex(wide)).otherwise(F.lit(""))))).drop("clash")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


RAW = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "d": "binary", "d_sha": "binary", "e": "binary", "e_sha": "binary", "near_edited": "double", "near_next": "double"}
RAW_SCHEMA = ", ".join(f"{k} {v}" for k, v in RAW.items())


def pa_types():
    import pyarrow as pa

    return pa


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
