"""The stages of the corpus pipeline: quality, exact copies, near copies, benchmark leaks, pieces.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; verdicts hold for rows (or for id and text together), never for ids, which may be
null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regtext.llm import decontaminate, exact_dedup, ngram_join, quality
from regtext.llm import sentencepiece_viterbi as pieces
from regtext.llm.support import remove, scratch, shared_dir

#: Near duplicates: words in a shingle, and percent of similarity.
WORDS, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, that with the smallest id."""
    return ngram_join.drop_near_duplicates(docs, n=WORDS, percent=PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, their ids, and whether they decode to the text."""
    vocabulary = pieces.Pieces.load()
    decoded = pieces.encode(docs, vocabulary, decoded=True)
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("text") == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("ngram_jaccard_join", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]

#: The classifier and the pieces have no SQL form; tests/llm/test_stages.py holds run() and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again for the next, and its intermediate tables and input then go."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
