"""Registry of named queries over the driver's tables, each with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.storage import deal_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            TWINS[fn.__name__] = sql
        return fn

    return register


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. On a small single file the caller may ask for more tasks by ``spark.labelmill.dealOut``."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = int(spark.conf.get("spark.labelmill.dealOut", "0"))
    return deal_out(rows, wanted, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a severity label: ``(row_id, text, label, source)``."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        lb.flag_severity([F.col("toxic")], [1 - F.col("quality")]).alias("label"),
    )
    return documents(spark, sf_dir).join(labels, "row_id").select("row_id", "text", "label", "source")


# The same table for the twins.
LABELLED_SQL = """labelled AS (
  SELECT d.doc_id AS row_id, d.text,
         CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END AS label, d.source
  FROM documents d JOIN labels l USING (doc_id))"""

STRIP = r"trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def sql_strip(c: str) -> str:
    return STRIP.format(c)


def sql_words(c: str) -> str:
    return WORDS.format(c)
