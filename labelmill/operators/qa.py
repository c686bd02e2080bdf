"""The quality gate over the finished splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.config import LABELS
from labelmill.functions import text as tx
from labelmill.operators.sampling import SPLITS, leakage


class QualityError(RuntimeError):
    pass


def invalid_labels(df: DataFrame, label: str = "label", labels=LABELS) -> DataFrame:
    """Rows per label outside the domain (null included)."""
    bad = ~F.coalesce(F.col(label).isin(*labels), F.lit(False))
    return df.filter(bad).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_check(rejected: DataFrame, subject: str) -> DataFrame:
    """The row of the gate for labels outside the domain that a table before the splits holds."""
    count = rejected.agg(F.count(F.lit(1)).alias("violations"))
    return count.select(F.lit("invalid_label").alias("check"), F.lit(subject).alias("subject"), "violations", (F.col("violations") == 0).alias("passed"))


def file_checks(spark: SparkSession, path: str) -> DataFrame:
    """``(check, subject, violations, passed)`` for each written text file: lines that are not valid UTF-8.

    The bytes of the files are looked at, not a decoded column; a line break never falls inside a character.
    """
    lines = spark.read.text(path)
    counts = lines.groupBy(F.col("_metadata.file_path").alias("subject")).agg(F.count_if(~F.is_valid_utf8("value")).alias("violations"))
    return counts.select(F.lit("invalid_utf8_file").alias("check"), "subject", "violations", (F.col("violations") == 0).alias("passed"))


def quality_checks(df: DataFrame, text: str = "text", label: str = "label", split: str = "split",
                   labels=LABELS, splits=SPLITS) -> DataFrame:
    """``(check, subject, violations, passed)`` for every split and every pair of splits."""
    t = F.col(text)
    in_domain = F.coalesce(F.col(label).isin(*labels), F.lit(False))
    checks = {
        "null_text": t.isNull(),
        "blank_text": tx.is_blank(t),
        "invalid_utf8": ~F.is_valid_utf8(t),
        "invalid_label": ~in_domain,
    }
    counts = df.groupBy(split).agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(split).alias("subject"), F.col(k).alias("violations"))
                     for k in checks])
    overlaps = leakage(df, text, split, splits).select(
        F.lit("overlap").alias("check"), F.col("pair").alias("subject"), F.col("overlap").alias("violations")
    )
    return counts.select(F.inline(rows)).unionByName(overlaps).withColumn("passed", F.col("violations") == 0)


def require_quality(checks: DataFrame) -> None:
    """Raise if any check failed (a handful of rows reach the driver)."""
    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise QualityError("; ".join(f"{r['check']} {r['subject']}: {r['violations']}" for r in failed))
