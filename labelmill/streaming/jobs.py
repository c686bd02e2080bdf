"""Structured Streaming forms of scoring, deduplication and statistics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelmill.functions import text as tx
from labelmill.operators.history import windowed_stats
from labelmill.operators.model import score

# Phrases that steer the listening loop and are not content.
CONTROL_WORDS = ("stop continuous", "stop loop", "exit", "quit", "stop listening")


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drop_control_words(df: DataFrame, text: str = "text", words=CONTROL_WORDS) -> DataFrame:
    """Remove control phrases and blank texts."""
    return df.filter(~tx.canonical(F.col(text)).isin(*words) & ~tx.is_blank(F.col(text)))


def score_stream(stream: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    return score(drop_control_words(stream, text), model, text)


def dedup_stream(stream: DataFrame, text: str = "text", ts: str | None = None, within: str = "1 hour") -> DataFrame:
    """First arrival of each canonical text.

    With an event time the state is bounded: a key is forgotten ``within`` after it was seen. The state holds
    digests, not texts.
    """
    keyed = stream.withColumn("_key", tx.fingerprint(tx.canonical(F.col(text))))
    if ts is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def log_stats_stream(stream: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "2 hours",
                     by: list[str] | None = None) -> DataFrame:
    """Count and mean per tumbling window (use ``append`` mode).

    A window comes out once, when the watermark has passed its end, and its state goes; rows later than that are left out.
    """
    return windowed_stats(stream.withWatermark(ts, late), ts, value, width, by)


def class_counts_stream(stream: DataFrame, ts: str, label: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and class (use ``update`` mode): changed counts come out at once, state goes with the watermark."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), label)
    return counts.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), label, "n")


def start_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly-once Parquet sink; with a checkpoint a restart adds no row twice."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def start_update(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the rows that each batch changed under ``path/batch=<n>``; a batch that is run again replaces its own folder."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the batches written by ``start_update``."""
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return spark.read.parquet(path).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")
