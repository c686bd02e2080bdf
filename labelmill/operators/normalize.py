"""Bring each raw corpus to the unified ``(text, label, source)`` shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.functions import text as tx


def unified(df: DataFrame, text: Column, label: Column, source: str) -> DataFrame:
    """Keeps ``row_id`` when the input has one."""
    ids = [F.col("row_id")] if "row_id" in df.columns else []
    return df.select(*ids, text.alias("text"), label.cast("int").alias("label"), F.lit(source).alias("source"))


def normalize_code(df: DataFrame, source: str = "davidson") -> DataFrame:
    return unified(df, F.col("tweet"), lb.map_code(F.col("class"), lb.CODE_MAP), source)


def normalize_binary(df: DataFrame, source: str = "olid", nonzero: bool = False) -> DataFrame:
    """``nonzero=True`` is the older reading: every code but 0 is offensive."""
    label = lb.binary_nonzero(F.col("label")) if nonzero else lb.map_code(F.col("label"), lb.BINARY_MAP)
    return unified(df, F.col("text"), label, source)


def normalize_annotated(df: DataFrame, source: str = "hatexplain", ties: str = "severity") -> DataFrame:
    """Majority vote of the annotators; posts without annotators get no label and are dropped."""
    votes = F.transform(F.col("annotators"), lambda a: a["label"])
    out = unified(df, tx.join_tokens(F.col("post_tokens")), lb.vote_in_row(votes, ties=ties), source)
    return out.filter(F.col("label").isNotNull())


def normalize_flags(df: DataFrame, source: str = "jigsaw") -> DataFrame:
    severe, mild = ["identity_hate", "threat"], ["toxic", "severe_toxic", "obscene", "insult"]
    return unified(
        df, F.col("comment_text"), lb.flag_severity([F.col(c) for c in severe], [F.col(c) for c in mild]), source
    )


def normalize_scores(df: DataFrame, source: str = "civil_comments", threshold: float = 0.5) -> DataFrame:
    severe = ["identity_attack", "threat"]
    mild = [c for c in ("toxicity", "severe_toxicity", "obscene", "insult", "sexual_explicit") if c in df.columns]
    return unified(
        df, F.col("text"), lb.score_severity([F.col(c) for c in severe], [F.col(c) for c in mild], threshold), source
    )


def mapping_table(spark) -> DataFrame:
    """The label codes as a table: source, original code, its meaning, class."""
    rows = [
        (source, code, meaning, label)
        for source, codes in lb.LABEL_MAPPING.items()
        for code, (meaning, label) in codes.items()
    ]
    return spark.createDataFrame(rows, "source string, original string, meaning string, label int")


def map_with_table(df: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Table-driven form of the code maps.

    ``mapping`` holds one row per label code (``original``, ``label``); Spark broadcasts it by
    its size. Unknown codes get a null label.
    """
    pairs = mapping.select(F.col("original").alias("_code"), "label")
    return df.join(pairs, F.col(code).cast("string") == F.col("_code"), "left").drop("_code")


def vote_by_key(
    df: DataFrame, key: str, vote: Column, order_by: str | None = None, labels=(0, 1, 2)
) -> DataFrame:
    """Majority label per key over flat ``(key, vote)`` rows, in one shuffle.

    One counter per class is combined on the map side, so a key with very many votes is no
    bottleneck. Ties: most severe class, or with ``order_by`` the class that was voted first.
    """
    counters = [F.count_if(F.col("_vote") == k).alias(f"_n{k}") for k in labels]
    seen = [F.min(F.when(F.col("_vote") == k, F.col(order_by))).alias(f"_at{k}") for k in labels] if order_by else []
    tally = df.withColumn("_vote", vote).groupBy(key).agg(*counters, *seen)
    ballots = F.array(
        *[
            F.struct(
                F.col(f"_n{k}").alias("n"),
                (F.coalesce(-F.col(f"_at{k}").cast("bigint"), F.lit(-(2**62))) if order_by else F.lit(k)).alias("rank"),
                F.lit(k).alias("label"),
            )
            for k in labels
        ]
    )
    best = F.array_max(ballots)
    return tally.select(key, F.when(best["n"] > 0, best["label"]).alias("label"), best["n"].alias("votes"))
