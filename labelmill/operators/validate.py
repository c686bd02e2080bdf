"""Structure and quality checks on raw sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.operators.dedup import duplicate_count, keep_first


def missing_columns(df: DataFrame, text: str, labels: list[str]) -> list[str]:
    """Required columns the table lacks (metadata only)."""
    return [c for c in [text, *labels] if c not in df.columns]


def require_columns(df: DataFrame, text: str, labels: list[str]) -> None:
    absent = missing_columns(df, text, labels)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def usable(df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """Rows with text that is neither null nor blank and with all labels."""
    return df.dropna(subset=[text, *labels]).filter(~tx.is_blank(F.col(text)))


def valid_rows(df: DataFrame, text: str, labels: list[str], order_by: str = "row_id") -> DataFrame:
    """Usable rows, first of each raw text."""
    require_columns(df, text, labels)
    return keep_first(usable(df, text, labels), tx.fingerprint(F.col(text)), order_by)


def null_text_count(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count_if(F.col(text).isNull()).alias("null_text_samples"))


def blank_text_count(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count_if(tx.is_blank(F.col(text))).alias("empty_text_samples"))


def missing_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in labels])


def validation_summary(
    df: DataFrame, text: str, labels: list[str], source: str = "source", id_col: str | None = None
) -> DataFrame:
    """One row per source: sizes, null and blank texts, missing labels, duplicates, rows removed.

    All sources in one job. Rows are first folded per (source, text digest), so the shuffle moves
    digests and counters, not texts, and a text held by many rows arrives as one row per map task.
    """
    require_columns(df, text, labels)
    t = F.col(text)
    has_labels = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in labels], F.lit(True))
    folded = df.groupBy(source, tx.fingerprint(t).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(t.isNull()).alias("_null"),
        F.count_if(tx.is_blank(t)).alias("_blank"),
        *[F.count_if(F.col(c).isNull()).alias(f"_no_{c}") for c in labels],
        F.max(F.coalesce(has_labels & ~tx.is_blank(t), F.lit(False))).alias("_usable"),
    )
    clean = F.count_if(F.col("_usable"))
    summary = folded.groupBy(source).agg(
        F.sum("_n").alias("total_raw_rows"),
        F.sum("_null").alias("null_text_samples"),
        F.sum("_blank").alias("empty_text_samples"),
        *[F.sum(f"_no_{c}").alias(f"missing_{c}") for c in labels],
        F.sum(F.col("_n") - 1).alias("duplicate_texts"),
        clean.alias("total_clean_rows"),
        (F.sum("_n") - clean).alias("removed_corrupted_or_invalid_rows"),
    )
    if id_col is None or id_col not in df.columns:
        return summary.withColumn("duplicate_ids", F.lit(0).cast("bigint"))
    ids = duplicate_count(df, F.col(id_col), [source]).withColumnRenamed("duplicates", "duplicate_ids")
    return summary.join(ids.withColumnRenamed(source, "_source"), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def source_report(df: DataFrame, text: str, labels: list[str], source: str = "source", encodings: DataFrame | None = None,
                  id_col: str | None = None) -> DataFrame:
    """``validation_summary`` that reports what is wrong with a source instead of raising.

    ``missing_columns`` lists required columns the table lacks; they count as null in every row. ``encodings (path, encoding)``, as
    ``readers.file_encodings`` gives them, adds the encoding of sources that are files; others have null.
    """
    absent = missing_columns(df, text, labels)
    full = df.withColumns({c: F.lit(None).cast("string") for c in absent})
    report = validation_summary(full, text, labels, source, id_col).withColumn("missing_columns", F.array(*[F.lit(c) for c in absent]).cast("array<string>"))
    if encodings is None:
        return report.withColumn("encoding", F.lit(None).cast("string"))
    known = encodings.select(F.col("path").alias("_path"), "encoding")
    return report.join(known, F.col(source) == F.col("_path"), "left").drop("_path")


def nested_reason(tokens: str = "post_tokens", annotators: str = "annotators"):
    """Why an annotated record is unusable, in the order of the checks; null for good ones."""
    toks, anns = F.col(tokens), F.col(annotators)
    no_list = lambda a: F.coalesce(F.size(a) <= 0, F.lit(True))
    return (
        F.when(no_list(toks), "corrupted")
        .when(tx.strip(tx.join_tokens(toks)) == "", "empty")
        .when(no_list(anns), "corrupted")
        .when(~F.forall(anns, lambda a: a["label"].isNotNull()), "corrupted")
    )


def tag_nested(df: DataFrame, id_col: str = "post_id", order_by: str | None = None) -> DataFrame:
    """Add ``reject_reason`` (``corrupted``, ``empty`` or null); rows of one id after the first fall out before."""
    return keep_first(df, F.col(id_col), order_by or id_col).withColumn("reject_reason", nested_reason())


def nested_summary(df: DataFrame, id_col: str = "post_id") -> DataFrame:
    """Counts of the annotated corpus: raw, corrupted, empty, duplicate ids and texts, clean, removed.

    An id and all its rows fold to one row on the map side; records of one id are taken as equal.
    """
    text = tx.join_tokens(F.col("post_tokens"))
    by_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(nested_reason()).alias("_reason"),
        F.min(tx.fingerprint(text)).alias("_text"),
    )
    by_text = by_id.groupBy("_text").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.col("_n") - 1).alias("_dup_ids"),
        F.count_if(F.col("_reason") == "corrupted").alias("_corrupted"),
        F.count_if(F.col("_reason") == "empty").alias("_empty"),
        F.count_if(F.col("_reason").isNull()).alias("_clean"),
    )
    return by_text.agg(
        F.sum("_n").alias("total_raw_rows"),
        F.sum("_corrupted").alias("corrupted"),
        F.sum("_empty").alias("empty_text_samples"),
        F.sum("_dup_ids").alias("duplicate_ids"),
        F.sum(F.greatest(F.col("_clean") - 1, F.lit(0))).alias("duplicate_texts"),
        F.sum("_clean").alias("total_clean_rows"),
        (F.sum("_n") - F.sum("_clean")).alias("removed_corrupted_or_invalid_rows"),
    )
