"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.functions import text as tx


def class_names(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per named class."""
    return df.groupBy(lb.label_name(F.col(label)).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    n_words, n_chars = tx.word_count(F.col(text)), F.char_length(text)
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.round(F.avg(n_words), 2).alias("average_words"),
        F.max(n_words).alias("max_words"),
        F.round(F.avg(n_chars), 2).alias("average_characters"),
        F.max(n_chars).alias("max_characters"),
    )


def word_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every word; combined on the map side, so common words are no hot keys."""
    return df.select(F.explode(tx.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_size(df: DataFrame, text: str = "text", approximate: bool = False) -> DataFrame:
    if approximate:
        tokens = df.select(F.explode(tx.words(F.col(text))).alias("word"))
        return tokens.agg(F.approx_count_distinct("word").alias("vocabulary_size"))
    return word_frequencies(df, text).agg(F.count(F.lit(1)).alias("vocabulary_size"))


SKETCH_BITS = 14  # 16,384 registers: a standard error of 0.8 %


def vocabulary_sketches(df: DataFrame, by: list[str], text: str = "text", bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of the distinct words for each group ``by``, made in one pass; to be stored and united later."""
    words = df.select(*by, F.explode(tx.words(F.col(text))).alias("word"))
    return words.groupBy(*by).agg(F.hll_sketch_agg("word", bits).alias("sketch"))


def vocabulary_estimates(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct words of each group ``by`` (none: of all sketches together), off by 2.5 % at most in 99.8 of 100 cases."""
    united = sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.select(*(by or []), F.hll_sketch_estimate("sketch").alias("vocabulary_size"))


def top_words(df: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """The ``k`` most frequent words; ties in word order, so the result does not depend on row order."""
    return word_frequencies(df, text).orderBy(F.desc("n"), "word").limit(k)


def word_count_histogram(df: DataFrame, bins: int = 40, text: str = "text") -> DataFrame:
    """Equal-width bins from the smallest to the largest word count, the last one closed on both sides."""
    sizes = df.groupBy(tx.word_count(F.col(text)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # over one row per distinct word count
    lo, hi = F.min("size").over(everything), F.max("size").over(everything)
    ranged = sizes.withColumns({"lo": lo, "hi": hi})
    scaled = F.try_divide((F.col("size") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))
    in_bin = F.least(F.floor(F.coalesce(scaled, F.lit(bins / 2))).cast("int"), F.lit(bins - 1))
    return ranged.groupBy(in_bin.alias("bin")).agg(
        F.round(F.min(F.col("lo") + in_bin * (F.col("hi") - F.col("lo")) / bins), 4).alias("bin_start"),
        F.sum("n").alias("n"),
    )


def stage_funnel(merge_stats: DataFrame) -> DataFrame:
    """Rows left after each merge stage, from the one-row merge statistics."""
    raw, noise = F.col("total_merged_input"), F.col("total_removed")
    dups = F.col("exact_and_canonical_duplicates_removed")
    stages = (
        ("raw merged", raw), ("after noise", raw - noise), ("after exact dedup", raw - noise - dups),
        ("after near dedup", F.col("total_output_rows")),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), n.alias("n"))
                     for i, (name, n) in enumerate(stages)])
    return merge_stats.select(F.inline(rows))


def statistics_document(df: DataFrame, merge_stats: DataFrame, split_meta: DataFrame, text: str = "text",
                        label: str = "label") -> DataFrame:
    """One row that nests all statistics, ready for a JSON sink; each part is a small aggregate."""
    parts = {
        "class_distribution": class_names(df, label).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("class_name", F.lit("none")).alias("class_name"), "n")))),
        "sentence_length": length_stats(df, text).select(
            F.struct("average_words", "max_words", "average_characters", "max_characters")),
        "vocabulary_size": vocabulary_size(df, text),
        "top_frequent_words": top_words(df, 20, text).agg(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False)),
        "merge_statistics": merge_stats.select(F.struct(*merge_stats.columns)),
        "split_statistics": split_meta.agg(F.sort_array(F.collect_list(F.struct(*split_meta.columns)))),
    }
    total = df.agg(F.count(F.lit(1)).alias("total_samples"))
    return total.select("total_samples", *[part.scalar().alias(name) for name, part in parts.items()])
