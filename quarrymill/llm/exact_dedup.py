"""Exact deduplication by a log-structured merge index, with DataFrame operations only.

1. Flush. The rows of a task are a memtable; each becomes a run of entries, one for a digest, with its rows' identifiers.
   Entries are dealt by digest and run, so a digest that a third of all rows share is an entry a run and never in one
   task. They are written to the shared folder sorted by digest, with Parquet's value ranges and Bloom filters, by which a
   later lookup of single digests skips row groups.
2. Compaction. All runs are merged into one level: for each digest the identifier that stays and the number of rows.
3. Lookup. Entries meet the compacted level by digest; a hot digest has as many entries as there are runs.
4. Byte verification. The texts of the hits (digests with several rows) are compared: a digest is sound if the least
   and the greatest of its texts are equal. Texts travel once, dealt by document, then combined per task, so no task
   gathers a group. Digests whose texts differ are regrouped by digest and text.

Null texts count as empty. All rows get a row: repeated ones too. Rows that repeat a doc_id with the same text are one
document told twice: each is counted in group_size and has the same keep_id and kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, prepare, texts

ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def flush(rows: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, text) -> the runs (sha, digest, run, ids), sorted, read back from the shared folder."""
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    entries = rows.select(sha.alias("sha"), F.spark_partition_id().alias("run"), "doc_id").groupBy("sha", "run").agg(F.collect_list("doc_id").alias("ids"))
    runs = entries.withColumn("digest", F.substring("sha", 1, digest_bytes)).sortWithinPartitions("digest")
    return materialize(runs, "dedup-run", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"})


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """One row for each digest: keep_id and group_size. Compacted levels can be merged again in the same way."""
    own, best = (F.array_max, F.max) if keep == "max" else (F.array_min, F.min)
    return runs.groupBy("digest").agg(best(own("ids")).alias("keep_id"), F.sum(F.size("ids")).alias("group_size"))


def unsound(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of hits (doc_id, digest) under which different texts were found."""
    both = rows.join(hits, "doc_id").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return both.where(F.col("least") != F.col("most")).select("digest")


def exact_duplicates(docs: DataFrame, keep: str = "min", digest_bytes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs. keep: the "min" or "max" identifier stays.
    Fewer digest_bytes make a smaller index and more work in verification, never another result."""
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    runs = flush(rows, digest_bytes)
    level = materialize(compact(runs, keep), "dedup-level")  # a table of its own: the join stands between exchanges
    found = runs.join(level, "digest").select("digest", "sha", "keep_id", "group_size", F.explode("ids").alias("doc_id"))
    hits = found.where("group_size > 1").select("doc_id", "digest").distinct()
    collided = materialize(unsound(rows, hits), "dedup-collided")
    if not collided.isEmpty():
        again = runs.join(collided, "digest", "left_semi").select(F.explode("ids").alias("doc_id")).distinct()
        split = rows.join(again, "doc_id").withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        split = split.join(collided.withColumn("split", F.lit(True)), F.substring("sha", 1, digest_bytes) == F.col("digest"))
        groups = split.groupBy("text").agg((F.max if keep == "max" else F.min)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        regrouped = split.join(groups, "text").select("doc_id", "sha", "keep_id", "group_size")
        found = found.join(collided, "digest", "left_anti").select("doc_id", "sha", "keep_id", "group_size").unionByName(regrouped)
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="max")
