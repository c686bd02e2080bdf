"""Sinks: stage tables, final CSV, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Parquet between stages (keeps nulls, types and texts such as ``NA`` intact); returns the written table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# White space at the ends of a text is part of it; left alone, the sink would cut it off.
WHOLE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside texts are doubled, white space at the ends stays. An empty text reads back as null; Parquet keeps it."""
    df.write.mode("overwrite").options(**WHOLE).csv(path)


def write_splits_csv(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, named ``split=<name>``."""
    df.write.mode("overwrite").partitionBy(split).options(**WHOLE).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A statistics document: a one-row table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
