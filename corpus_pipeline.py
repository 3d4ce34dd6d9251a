"""From raw documents to encoded training data: five stages, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
models and the benchmark come from the tables in sf_dir, decisions from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session
from factloom.llm import common, decontamination, neardup, pii, quality, sentencepiece_fst


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column beside the text, so that no column can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    session.ship(spark)
    model = quality.learned(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.scored(packed(docs), model).where("predicted = 1").select("row.*")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the least doc_id; of equal rows one, rows without doc_id stay."""
    session.ship(spark)
    least = neardup.classes(docs).where(F.col("doc_id") == F.col("class_id"))
    kept = least.select("doc_id", F.coalesce(F.hex("digest"), F.lit("")).alias("digest")).distinct()
    rows = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.upper(F.md5("text")), F.lit("")).alias("digest"))
    named = rows.join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return named.unionByName(rows.where(F.col("doc_id").isNull())).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    session.ship(spark)
    covered = decontamination.most_covered(packed(docs), common.table(spark, sf_dir, "benchmark"))
    return covered.where(F.col("coverage") < decontamination.COVERAGE).select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars by the new length."""
    masked = pii.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and round_trip of each document."""
    session.ship(spark)
    return sentencepiece_fst.encoded(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: The stages are not expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{i}")
    return docs
