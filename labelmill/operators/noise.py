"""Rules that recognise unusable text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelmill.functions import text as tx

RULES = ("too_short", "too_few_words", "only_numbers", "only_symbols", "spam")


def noise_rules(text: Column, words: Column, min_length: int = 5, unicode: bool = False) -> dict[str, Column]:
    """One boolean per rule.

    ``only_symbols`` looks for ASCII letters and digits, so text wholly in another script counts
    as symbols; ``unicode=True`` accepts letters and digits of every script.
    """
    alnum = r"\p{L}\p{N}" if unicode else "a-zA-Z0-9"
    n = F.size(words)
    return {
        "too_short": F.char_length(text) < min_length,
        "too_few_words": n < 2,
        "only_numbers": text.rlike(r"^\p{Nd}+$"),
        "only_symbols": text.rlike(f"^[^{alnum}]+$"),
        "spam": (n > 10) & (F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)) < 0.2),
    }


def flag_noise(df: DataFrame, text: str = "text", min_length: int = 5, unicode: bool = False) -> DataFrame:
    """Add one boolean column per rule and ``is_noise``; null text is noise but breaks no rule."""
    df = df.withColumn("_words", tx.words(F.col(text)))
    df = df.withColumns(
        {k: F.coalesce(v, F.lit(False)) for k, v in noise_rules(F.col(text), F.col("_words"), min_length, unicode).items()}
    ).drop("_words")
    broken = reduce(lambda a, b: a | b, [F.col(r) for r in RULES])
    return df.withColumn("is_noise", F.col(text).isNull() | broken)


def watched(flagged: DataFrame, seen: Observation, among: Column | None = None) -> DataFrame:
    """``flag_noise``'s table, whose rows per rule are counted by the job that writes it; ``seen`` has them after that.

    ``among``: only these rows count. With no rows all counts are 0.
    """
    within = F.lit(True) if among is None else among
    counts = {r: F.count_if(within & F.col(r)) for r in RULES}
    return flagged.observe(seen, F.count_if(within).alias("rows"), *[c.alias(k) for k, c in counts.items()],
                           F.count_if(within & F.col("is_noise")).alias("total_removed"))


def remove_noise(df: DataFrame, text: str = "text", min_length: int = 5, unicode: bool = False) -> DataFrame:
    return flag_noise(df, text, min_length, unicode).filter(~F.col("is_noise")).drop("is_noise", *RULES)


def noise_stats(df: DataFrame, text: str = "text", min_length: int = 5, unicode: bool = False) -> DataFrame:
    """Rows per rule (rules overlap) and rows removed in all, nulls included."""
    return flag_noise(df, text, min_length, unicode).agg(
        *[F.count_if(F.col(r)).alias(r) for r in RULES], F.count_if(F.col("is_noise")).alias("total_removed")
    )
