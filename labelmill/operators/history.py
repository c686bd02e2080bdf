"""Prediction history and request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, query: str = "", prediction: str = "all", text: str = "text",
           label: str = "prediction") -> DataFrame:
    """Case-insensitive substring and class filter; an empty query and ``all`` let everything pass."""
    hit = F.contains(F.lower(text), F.lit(query.lower()))
    return df.filter(hit) if prediction == "all" else df.filter(hit & (F.col(label) == prediction))


def mean_latency(df: DataFrame, ms: str = "processing_time_ms", default: str = "~12ms") -> DataFrame:
    """Mean with one decimal as text, or the default for an empty history."""
    mean = F.avg(ms)
    return df.agg(F.when(mean.isNull(), default).otherwise(F.format_string("%.1fms", mean)).alias("latency"))


def newest_first(df: DataFrame, ts: str = "timestamp", id_col: str = "id", top: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc(ts), F.desc(id_col))
    return ordered if top is None else ordered.limit(top)


def delete_by_id(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def request_log(df: DataFrame, path: str = "path", ms: str = "duration_ms", ignore: tuple[str, ...] = ("/health",)) -> DataFrame:
    """Requests without health checks, duration with 2 decimals."""
    return df.filter(~F.col(path).isin(*ignore)).withColumn(ms, F.round(ms, 2))


def request_stats(df: DataFrame, by: list[str], ms: str = "duration_ms") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ms), 2).alias("avg_ms"), F.round(F.max(ms), 2).alias("max_ms")
    )


def windowed_stats(df: DataFrame, ts: str, value: str, width: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Tumbling-window count and mean; the same expression serves batch and stream."""
    return df.groupBy(F.window(ts, width).alias("window"), *(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    ).select(F.col("window.start").alias("window_start"), *(by or []), "n", "mean")


EXPORT_COLUMNS = {
    "timestamp": "Timestamp", "text": "Comment text", "prediction": "Prediction", "confidence": "Confidence",
    "Safe": "Safe Prob", "Offensive": "Offensive Prob", "Hate Speech": "Hate Speech Prob",
    "processing_time_ms": "Processing Time MS",
}


def export_rows(df: DataFrame) -> DataFrame:
    """Flat eight-column form of the history (probabilities struct opened)."""
    flat = df.select("timestamp", "text", "prediction", "confidence", "probabilities.*", "processing_time_ms")
    return flat.select([F.col(f"`{k}`").alias(v) for k, v in EXPORT_COLUMNS.items()])
