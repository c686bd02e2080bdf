"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill import storage
from labelmill.storage import discard, shared_dir

__all__ = ["SPACE", "ascii_lower", "count_words", "discard", "docs_table", "materialize", "shared_dir", "small", "whole", "Carried"]

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1000  # texts in one Arrow batch: bounds what a Python worker and the JVM's buffers for it hold at once

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``storage.materialize`` with small Arrow batches while it runs; the session's own setting comes back after it."""
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(BATCH))
    try:
        return storage.materialize(df, name, group_rows)
    finally:
        conf.set(ARROW_ROWS, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str = "text") -> Column:
    """The whole text, a null one as an empty one."""
    return F.coalesce(F.col(quoted(text)), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE)).cast("long")


class Carried:
    """The columns of a table on their way through an operator, under names that clash with nothing.

    ``replaced``: names of result columns; columns of these names, in whatever case, are left behind.
    """

    def __init__(self, df: DataFrame, *replaced: str):
        taken = {n.lower() for n in replaced}
        self.names = [c for c in df.columns if c.lower() not in taken]
        self.cols = [F.col(quoted(c)).alias(f"_in{i}") for i, c in enumerate(self.names)]
        held = df.select(*[F.col(quoted(c)) for c in self.names]).schema.fields
        self.fields = T.StructType([T.StructField(f"_in{i}", f.dataType) for i, f in enumerate(held)]).toDDL()  # quotes names inside structs

    def back(self, **instead: Column) -> list[Column]:
        """The columns under their own names; ``instead`` puts others in the place of some."""
        return [instead[c].alias(c) if c in instead else F.col(f"_in{i}").alias(c) for i, c in enumerate(self.names)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
