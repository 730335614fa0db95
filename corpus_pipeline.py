"""From documents to packed training sequences, in five stages, each over all that the one before it kept.

A stage gets its predecessor's rows as read from Parquet and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, line_dedup, mixing, packing
from tessera.llm.common import materialise, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no letters, no text, or not told apart) go."""
    return language_id.keep_identified(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: near-equal lines, and equal short ones, stay once; documents that keep nothing but white space of what they had go. n_chars is counted anew."""
    out = line_dedup.deduplicate_lines(docs)
    removed = F.col(out.columns[-1])
    kept = out.where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n-gram Jaccard join: of documents that links connect, the one with the smallest doc_id stays."""
    return jaccard_join.keep_representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target weight takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: which words of which row lie where in which training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", lines_once),
    ("jaccard_join", one_of_each),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Edit distances, trained models and packing have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
