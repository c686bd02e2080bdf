"""Union of corpora, label conflicts, canonical deduplication and the statistics of the merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.config import LABELS
from labelmill.functions import text as tx
from labelmill.operators.dedup import keep_first

SOURCE_BITS = 56  # leaves room for ids of 8 million partitions (bits 33 and up) and 128 sources


def unite(tables: list[DataFrame], row_id: str = "row_id") -> DataFrame:
    """Stack the corpora in the given order; ids are shifted so that they order the whole stack.

    An id that would reach into the next corpus is an error, never a clash.
    """
    if len(tables) > 128:
        raise ValueError("at most 128 corpora")
    fits = F.col(row_id).between(0, (1 << SOURCE_BITS) - 1)
    wide = F.raise_error(F.lit(f"{row_id} must be below 2**{SOURCE_BITS}")).cast("bigint")
    shifted = [
        t.withColumn(row_id, F.when(fits, F.shiftleft(F.lit(i).cast("bigint"), SOURCE_BITS) + F.col(row_id)).otherwise(wide))
        for i, t in enumerate(tables)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shifted)


def label_groups(df: DataFrame, key: str, label: str = "label", source: str = "source",
                 order_by: str = "row_id", labels=LABELS) -> DataFrame:
    """One row per key: a counter per class, the sources and the id of the first row, in a single shuffle of digests.

    Everything is combined on the map side; the state per key is bounded by the number of classes and
    of sources, however many rows the key has. ``first_rows`` brings the texts back.
    """
    return df.groupBy(_digest(key).alias("_digest")).agg(
        *[F.count_if(F.col(label) == k).alias(f"_n{k}") for k in labels],
        F.max(label).alias("_max"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.min(order_by).alias(order_by),
    )


def first_rows(groups: DataFrame, df: DataFrame, key: str, columns: dict[str, str], order_by: str = "row_id") -> DataFrame:
    """Join each group with columns (old name to new) of its first row; ids are unique, so no group is hot.

    Should rows share an id after all, one of them stands for the group; a group has one id, so the rows lie as the join left them.
    """
    firsts = df.select(order_by, _digest(key).alias("_digest"), *[F.col(c).alias(new) for c, new in columns.items()])
    return groups.join(firsts, [order_by, "_digest"]).dropDuplicates([order_by, "_digest"])


def _counts(labels=LABELS):
    return [F.col(f"_n{k}") for k in labels]


def is_conflict(labels=LABELS):
    return reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in _counts(labels)]) > 1


def resolved_label(strategy: str, labels=LABELS):
    """``majority_vote`` (a shared top count gives the most severe label present), ``severity_priority``
    or ``remove`` (null)."""
    counts = _counts(labels)
    if strategy == "severity_priority":
        return F.col("_max")
    if strategy == "remove":
        return F.lit(None).cast("int")
    if strategy != "majority_vote":
        raise ValueError(f"unknown strategy {strategy}")
    top = F.greatest(*counts)
    shared = reduce(lambda a, b: a + b, [(c == top).cast("int") for c in counts]) > 1
    winner = reduce(lambda acc, kc: acc.when(kc[1] == top, F.lit(kc[0])), zip(labels, counts), F)
    return F.when(shared, F.col("_max")).otherwise(winner).cast("int")


def _digest(key: str):
    return tx.fingerprint(F.col(key).cast("string"))


def conflict_groups(df: DataFrame, key: str, label: str = "label", order_by: str = "row_id") -> DataFrame:
    """Keys with more than one label, as digests, with the id of their first row."""
    groups = df.groupBy(_digest(key).alias("_digest")).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.min(order_by).alias(order_by))
    return groups.filter("_lo <> _hi").select("_digest", order_by)


def conflict_keys(df: DataFrame, key: str, label: str = "label", order_by: str = "row_id") -> DataFrame:
    """Keys with more than one label."""
    return first_rows(conflict_groups(df, key, label, order_by), df, key, {key: key}, order_by).select(key)


def split_conflicts(df: DataFrame, key: str, label: str = "label", order_by: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose key has one label, and rows whose key has several (anti and semi join)."""
    keys = conflict_groups(df, key, label, order_by).select("_digest")
    tagged = df.withColumn("_digest", _digest(key))
    return tagged.join(keys, "_digest", "left_anti").drop("_digest"), tagged.join(keys, "_digest", "left_semi").drop("_digest")


def drop_conflicts(df: DataFrame, key: str, label: str = "label", order_by: str = "row_id") -> DataFrame:
    """Remove all rows of conflicting keys; to be run before deduplication."""
    return split_conflicts(df, key, label, order_by)[0]


def resolve_and_dedup(
    df: DataFrame, strategy: str = "majority_vote", key: str = "canonical_text", label: str = "label",
    source: str = "source", order_by: str = "row_id", labels=LABELS,
) -> DataFrame:
    """Exactly one row per key: ``(row_id, text, label, source)``.

    Keys with one label keep their first row; conflicting keys get the resolved label and all their
    sources joined by ``|``. ``text`` is the key itself. With ``remove`` conflicting keys vanish.
    """
    groups = first_rows(label_groups(df, key, label, source, order_by, labels), df, key, {key: "_text", label: "_label", source: "_source"}, order_by)
    conflict = is_conflict(labels)
    out = groups.select(
        order_by,
        F.col("_text").alias("text"),
        F.when(conflict, resolved_label(strategy, labels)).otherwise(F.col("_label")).alias(label),
        F.when(conflict, F.array_join("sources", "|")).otherwise(F.col("_source")).alias(source),
        conflict.alias("_conflict"),
    )
    if strategy == "remove":
        out = out.filter(~F.col("_conflict"))
    return out.drop("_conflict")


def conflict_audit(
    df: DataFrame, strategy: str = "majority_vote", key: str = "canonical_text", label: str = "label",
    source: str = "source", order_by: str = "row_id", labels=LABELS,
) -> DataFrame:
    """Label histogram, sources and outcome of every conflicting key."""
    groups = label_groups(df, key, label, source, order_by, labels).filter(is_conflict(labels))
    groups = first_rows(groups, df, key, {key: "_text"}, order_by)
    histogram = F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*_counts(labels)))
    return groups.select(
        F.col("_text").alias("text"),
        F.map_filter(histogram, lambda k, v: v > 0).alias("original_labels"),
        "sources",
        resolved_label(strategy, labels).alias("resolved_label"),
        F.lit(strategy).alias("strategy"),
    )


def conflict_report(audit: DataFrame, top: int = 20, width: int = 60) -> DataFrame:
    """The first conflicts in key order, with shortened text (a top-k report)."""
    shown = F.when(F.char_length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("...")))
    label = F.coalesce(F.concat(F.lit("class "), F.col("resolved_label").cast("string")), F.lit("DROPPED"))
    histogram = F.array_join(
        F.transform(F.map_entries("original_labels"),
                    lambda e: F.format_string("class %d: %d times", e["key"], e["value"])), ", ")
    return audit.orderBy("text").limit(top).select(
        shown.otherwise(F.col("text")).alias("text"), histogram.alias("label_frequencies"),
        F.array_join("sources", ", ").alias("sources"), label.alias("resolved_label"))


def canonical_dedup(df: DataFrame, text: str = "text", order_by: str = "row_id") -> DataFrame:
    """First row of every canonical text."""
    return keep_first(df, tx.fingerprint(tx.canonical(F.col(text))), order_by)


def merge_statistics(df: DataFrame, near_duplicates: DataFrame, text: str = "text", min_length: int = 5,
                     label: str = "label") -> DataFrame:
    """One row with the rows each merge stage removed.

    ``df`` is the united corpus, ``near_duplicates`` the rows dropped as near copies. Rows are folded
    per canonical text before they are counted, so the shuffle carries digests only. Rows that carry the flags of ``flag_noise``
    already are not looked at again.
    """
    from labelmill.operators.noise import RULES, flag_noise

    flagged = df if {"is_noise", *RULES} <= set(df.columns) else flag_noise(df, text, min_length)
    flagged = flagged.withColumn("_key", tx.fingerprint(tx.canonical(F.col(text))))
    usable_label = F.when(~F.col("is_noise"), F.col(label))
    folded = flagged.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(r)).alias(r) for r in RULES],
        F.count_if(F.col("is_noise")).alias("_noise"),
        F.min(usable_label).alias("_lo"),
        F.max(usable_label).alias("_hi"),
    )
    clean = F.col("_n") - F.col("_noise")
    totals = folded.agg(
        F.sum("_n").alias("total_merged_input"),
        *[F.sum(r).alias(r) for r in RULES],
        F.sum("_noise").alias("total_removed"),
        F.sum(F.greatest(clean - 1, F.lit(0))).alias("exact_and_canonical_duplicates_removed"),
        F.count_if(F.col("_lo") < F.col("_hi")).alias("conflicts_detected"),
        F.count_if(clean > 0).alias("_distinct"),
    )
    near = near_duplicates.agg(F.count(F.lit(1))).scalar()
    counted = totals.withColumn("near_duplicates_removed", near)
    return counted.withColumn("total_output_rows", F.col("_distinct") - F.col("near_duplicates_removed")).drop("_distinct")
