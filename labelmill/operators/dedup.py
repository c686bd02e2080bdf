"""Keep-first deduplication and duplicate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, order_by: str = "row_id") -> DataFrame:
    """First row of every key in ``order_by`` order.

    The filter ``rank = 1`` lets Spark cut each map task to one row per key before the
    shuffle (WindowGroupLimit), so a key held by a third of all rows costs no more than a rare one.
    """
    first = Window.partitionBy("_key").orderBy(order_by)
    return (
        df.withColumn("_key", key)
        .withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .drop("_key", "_rank")
    )


def duplicate_count(df: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """Rows after the first of every key, nulls counting as equal; optionally per group ``by``."""
    by = by or []
    groups = df.groupBy(*by, key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*by).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
