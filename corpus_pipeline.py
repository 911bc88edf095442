"""From raw documents to packed sequences, in five stages.

Each stage is an operator of quarrymill.llm; it gets what its predecessor kept, as a table, and returns the columns of
documents, but for the last one, which returns the pieces of the packed sequences. Rows with null texts have no language
and go in the first stage; an empty table passes through all stages; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import exact_dedup, language, packing, personal_data, simhash
from quarrymill.llm.common import STAYS, discard, materialize, passing, release, stored, tokenizer_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text lies near a language that the table's labels teach; null texts and texts without letters go."""
    return language.keep_known(docs, language.learn(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same text, the one with the largest doc_id; of rows with the same doc_id and text the first one, in
    the order of their columns as JSON."""
    with passing(spark):
        found = exact_dedup.exact_duplicates(docs, keep="max").where("kept")
        staying = found.groupBy(F.col("doc_id").alias("staying"), F.col("text_sha256").alias("digest")).agg((F.count(F.lit(1)) > 1).alias("several"))
        staying = materialize(staying, "exact-staying", STAYS)
    release(spark)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    same = lambda ids: (F.col("doc_id") == ids["staying"]) & (digest == ids["digest"])
    once, more = staying.where("not several"), staying.where("several")
    kept = docs.join(once, same(once), "left_semi")
    if more.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = docs.join(more, same(more), "left_semi").groupBy("doc_id", digest.alias("digest")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionByName(first.select("row.*"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the smallest doc_id: linked are texts whose sets of five-word shingles have a
    similarity of 0.8 at least. If that doc_id stands on several texts of the group, the one with the smallest digest."""
    found = simhash.similar_documents(docs, words=5, similarity=0.8).where("doc_id = component_id")
    staying = found.groupBy(F.col("doc_id").alias("staying")).agg(F.min("text_sha256").alias("digest"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.join(staying, (F.col("doc_id") == staying["staying"]) & (digest == staying["digest"]), "left_semi")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind; n_chars follows."""
    redacted = personal_data.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", known_language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal),
    ("packing", packed),
]

#: SQL has neither the tokenizer nor the classifiers of these stages; tests/llm/test_pipeline.py holds each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
