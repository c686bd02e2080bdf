"""From raw documents to a mixed training corpus: quality, line dedup, near-dedup, decontamination, mixing.

Each stage works on the Parquet table that the one before has written. All but the last return the columns of ``documents``; the
last returns the mixed corpus: a row, with its text, for each time a document is drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import decontam, line_dedup, mixing, near_dedup, quality
from labelmill.llm.common import docs_table, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from their language reject go."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first one; the texts get shorter, no document goes."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    judged = decontam.find_contamination(docs, docs_table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix draws, once for each time, with ``size``, ``target``, words ``taken``, ``shard`` and ``position``."""
    return mixing.take(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near-dedup", near_deduplication),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

# The quality verdict and the permuted blocks of the mix are beyond SQL; tests compare the stages with the operators, and the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
