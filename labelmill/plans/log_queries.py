"""Queries on logs and history, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.operators import history
from labelmill.plans.model_queries import _prepared, _trained
from labelmill.plans.registry import query, sql_strip, table
from labelmill.storage import new_path
from labelmill.streaming import jobs

TS = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"


def _text_ts(df, c="window_start"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE lower(text) LIKE '%the%' AND role = 'user'")
def history_search(spark, d):
    return history.search(table(spark, d, "conversations"), "THE", "user", label="role").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn FROM conversations WHERE lower(text) LIKE '%de%'")
def history_search_all(spark, d):
    return history.search(table(spark, d, "conversations"), "de").select("conv_id", "turn")


@query("SELECT printf('%.1fms', avg(value)) AS latency FROM events")
def mean_latency(spark, d):
    return history.mean_latency(table(spark, d, "events"), "value")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_first(spark, d):
    return history.newest_first(table(spark, d, "events"), "ts", "event_id", 50).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def delete_by_id(spark, d):
    events = table(spark, d, "events")
    gone = events.filter("event_type = 'error'").select("event_id")
    return history.delete_by_id(events, gone, "event_id").select("event_id", "user_id")


@query("""SELECT event_id, event_type AS path, round(value, 1) AS duration_ms, CAST(json_extract(props, '$.k') AS INT) AS status_code
FROM events WHERE event_type <> 'signup'""")
def request_log(spark, d):
    """Events as a request log: the JSON column is parsed, one kind of event plays the health check."""
    parsed = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("path"), F.round("value", 1).alias("duration_ms"),
        F.from_json("props", "k int")["k"].alias("status_code"))
    return history.request_log(parsed, ignore=("signup",))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 2) AS avg_ms, round(max(value), 2) AS max_ms FROM events GROUP BY event_type""")
def request_stats(spark, d):
    return history.request_stats(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT event_id AS "Timestamp", event_type AS "Comment text", event_type AS "Prediction", value AS "Confidence",
  value / 2 AS "Safe Prob", value / 4 AS "Offensive Prob", value / 8 AS "Hate Speech Prob", value AS "Processing Time MS" FROM events""")
def history_export(spark, d):
    v = F.col("value")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("timestamp"), F.col("event_type").alias("text"), F.col("event_type").alias("prediction"),
        v.alias("confidence"), F.struct((v / 2).alias("Safe"), (v / 4).alias("Offensive"), (v / 8).alias("Hate Speech")).alias("probabilities"),
        v.alias("processing_time_ms"))
    return history.export_rows(rows)


WINDOW_SQL = f"SELECT {TS} AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"
CLASS_SQL = f"SELECT {TS} AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(WINDOW_SQL)
def log_windows(spark, d):
    out = history.windowed_stats(table(spark, d, "events"), "ts", "value", by=["event_type"])
    return _text_ts(out).withColumn("mean", F.round("mean", 6))


def _events(spark, d):
    events = jobs.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs the zoned type


@query(WINDOW_SQL.replace("FROM events GROUP BY ALL", "FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"))
def stream_log_windows(spark, d):
    """From a stream that is run to its end: the windows that the watermark has closed, each written once."""
    stream = jobs.log_stats_stream(_events(spark, d), "ts", "value", by=["event_type"])
    path = new_path(spark, "log-windows")
    jobs.start_append(stream, path, path + "-checkpoint").awaitTermination()
    return _text_ts(spark.read.schema(stream.schema).parquet(path)).withColumn("mean", F.round("mean", 6))


PARTS = 4


def _in_runs(spark, name, rows, order, start, extra=None):
    """Feed ``rows`` to ``start(stream, path, checkpoint)`` in ``PARTS`` runs by ranges of ``order``; return the sink's path.

    Every run is a query of its own that goes on from the checkpoint of the one before. ``extra`` rows come late, in the last run.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    path = new_path(spark, name)
    source = path + "-source"
    part = F.least(F.floor((order - low) * PARTS / max(high - low, 1)), F.lit(PARTS - 1)) if low is not None else F.lit(0)
    part = F.coalesce(part, F.lit(0))  # rows without a place come first
    for k in range(PARTS):
        fed = rows.where(part == k)
        (fed.unionByName(extra) if extra is not None and k == PARTS - 1 else fed).write.mode("append").parquet(source)
        start(jobs.read_stream(spark, source, rows.schema), path, path + "-checkpoint").awaitTermination()
    return path


def _late_events(events):
    """Events of the first day once more: far behind the watermark by the time the last run reads them."""
    return events.where(F.col("ts") < events.agg(F.date_trunc("day", F.min("ts")) + F.expr("INTERVAL 1 DAY")).first()[0])


def _typed_events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(WINDOW_SQL.replace("FROM events GROUP BY ALL", "FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"))
def stream_log_windows_restarted(spark, d):
    """The same windows from four runs, each restarted from the checkpoint; late rows in the last run change nothing."""
    events = _typed_events(spark, d)
    work = lambda stream: jobs.log_stats_stream(stream, "ts", "value", by=["event_type"])
    path = _in_runs(spark, "log-windows-runs", events, F.unix_seconds("ts"), lambda s, p, c: jobs.start_append(work(s), p, c), _late_events(events))
    return _text_ts(spark.read.schema(work(events).schema).parquet(path)).withColumn("mean", F.round("mean", 6))


@query(CLASS_SQL)
def stream_class_counts_restarted(spark, d):
    """Counts that change from run to run: the newest row of each window and class holds; late rows change nothing."""
    events = _typed_events(spark, d)
    path = _in_runs(spark, "class-counts-runs", events, F.unix_seconds("ts"),
                    lambda s, p, c: jobs.start_update(jobs.class_counts_stream(s, "ts", "event_type"), p, c), _late_events(events))
    return _text_ts(jobs.read_current(spark, path, ["window_start", "event_type"]))


@query(CLASS_SQL)
def stream_class_counts(spark, d):
    path = new_path(spark, "class-counts")
    jobs.start_update(jobs.class_counts_stream(_events(spark, d), "ts", "event_type"), path, path + "-checkpoint").awaitTermination()
    return _text_ts(jobs.read_current(spark, path, ["window_start", "event_type"]))


@query(f"SELECT DISTINCT {sql_strip('lower(text)')} AS text FROM documents")
def stream_dedup(spark, d):
    """Documents arrive one a second, in four runs that go on from each other's state; a text is kept in mind as long as ids go on."""
    docs = table(spark, d, "documents")
    low, high = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    # A watermark starts at second 0, and rows at it are late: the first document comes at second 1.
    docs, span = docs.withColumn("ts", F.timestamp_seconds(F.col("doc_id") - low + 1)), f"{high - low + 1} seconds"
    path = _in_runs(spark, "stream-dedup", docs, F.col("doc_id"), lambda s, p, c: jobs.start_append(jobs.dedup_stream(s, ts="ts", within=span), p, c))
    return spark.read.schema(docs.schema).parquet(path).select(tx.canonical(F.col("text")).alias("text"))


@query("SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) NOT IN ('household', 'machinery')")
def control_words(spark, d):
    rows = table(spark, d, "customer")
    return jobs.drop_control_words(rows, "c_mktsegment", ("household", "machinery")).select("c_custkey")


@query()
def stream_scoring(spark, d):
    """A model trained in batch scores the conversations as they arrive."""
    fitted = _trained(_prepared(spark, d))
    talk = jobs.read_stream(spark, f"{d}/conversations*.parquet", table(spark, d, "conversations").schema)
    scored = jobs.score_stream(talk, fitted).select("conv_id", "turn", "prediction_name", "confidence")
    path = new_path(spark, "stream-scoring")
    jobs.start_append(scored, path, path + "-checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).parquet(path)
