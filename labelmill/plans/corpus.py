"""The corpus build as one Spark application.

Tables are written where the work is costly and reused (after cleaning, after resolving, after
merging); everything between is lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelmill.config import NEAR_COPY, SHORTEST, SOURCE_ORDER, Split
from labelmill.functions import text as tx
from labelmill.operators import clean, merge, neardup, noise, normalize, qa, sampling, stats, validate
from labelmill.operators.dedup import keep_first
from labelmill.schemas import FLAG_COLUMNS, SCORE_COLUMNS
from labelmill.sources.writers import write_json, write_splits_csv, write_stage
from labelmill.storage import materialize

CODE_COLUMNS = ["class"]
# Validation asks for all flags, and for all scores but the last, which not every export carries.
FLAG_LABELS, SCORE_LABELS = list(FLAG_COLUMNS), list(SCORE_COLUMNS[:-1])


@dataclass(frozen=True)
class Source:
    """How one raw corpus is checked and brought to the unified shape."""

    text: str
    labels: list[str]
    normalize: Callable[[DataFrame], DataFrame]


SOURCES = {
    "davidson": Source("tweet", CODE_COLUMNS, normalize.normalize_code),
    "olid": Source("text", ["label"], normalize.normalize_binary),
    "jigsaw": Source("comment_text", FLAG_LABELS, normalize.normalize_flags),
    "civil_comments": Source("text", SCORE_LABELS, normalize.normalize_scores),
}


def number_rows(df: DataFrame, name: str = "numbered") -> DataFrame:
    """Give rows an id in input order and fix it by writing the table (an unfixed id may change on retry)."""
    if "row_id" in df.columns:
        return df
    return materialize(df.withColumn("row_id", F.monotonically_increasing_id()), name)


def unify_source(name: str, raw: DataFrame) -> DataFrame:
    """Validate and normalise one raw corpus."""
    raw = number_rows(raw, name)
    if name == "hatexplain":
        good = validate.tag_nested(raw, "post_id", "row_id").filter(F.col("reject_reason").isNull())
        return normalize.normalize_annotated(good.drop("reject_reason"))
    source = SOURCES[name]
    return source.normalize(validate.valid_rows(raw, source.text, source.labels))


def unify_sources(raws: dict[str, DataFrame]) -> DataFrame:
    """All corpora in the fixed order."""
    return merge.unite([unify_source(n, raws[n]) for n in SOURCE_ORDER if n in raws])


def build_corpus(unified: DataFrame, out: str, steps: tuple[clean.Step, ...] = clean.STEPS, language: str | None = "en",
                 split: Split = Split(), conflicts: str = "majority_vote", shortest: int = SHORTEST, near_copy: float = NEAR_COPY,
                 gate: bool = True) -> dict[str, DataFrame]:
    """``(row_id, text, label, source)`` in; cleaned, merged and split tables, reports and checks out.

    ``conflicts``: ``majority_vote``, ``severity_priority`` or ``remove``. Merged rows with a label outside the domain are written
    to ``rejected`` and fail the gate; they never vanish unseen.
    """
    # Cleaning and noise flags are one pass, and the job that writes them counts them.
    seen = Observation("corpus-noise")
    flagged = noise.flag_noise(clean.tag_cleaned(unified, "text", steps, language), "text", shortest)
    tagged = write_stage(noise.watched(flagged, seen, F.col("drop_reason").isNull()), f"{out}/cleaned")
    united = clean.kept(tagged)
    usable = united.filter(~F.col("is_noise")).drop("is_noise", *noise.RULES)
    noise_counts = unified.sparkSession.createDataFrame([seen.get])
    keyed = usable.withColumn("canonical_text", tx.canonical(F.col("text")))
    resolved = write_stage(merge.resolve_and_dedup(keyed, conflicts), f"{out}/resolved")
    near = write_stage(neardup.removed_by(resolved, threshold=near_copy), f"{out}/near_duplicates")
    merged = write_stage(
        resolved.join(near.select(F.col("id").alias("row_id")), "row_id", "left_anti"), f"{out}/merged"
    )
    rejected = write_stage(sampling.rejected_labels(merged), f"{out}/rejected")
    sampled = sampling.undersample(merged, split.per_class, seed=split.seed)
    splits = write_stage(sampling.stratified_split(sampled, split), f"{out}/splits", ["split"])
    write_splits_csv(splits.select("text", "label", "source", "split"), f"{out}/splits_csv")

    merge_stats = write_stage(merge.merge_statistics(united, near, min_length=shortest), f"{out}/merge_statistics")
    split_meta = sampling.split_metadata(splits)
    write_json(stats.statistics_document(merged, merge_stats, split_meta), f"{out}/dataset_statistics")
    checks = write_stage(qa.quality_checks(splits).unionByName(qa.label_check(rejected, "merged")), f"{out}/checks")
    if gate:
        qa.require_quality(checks)
    return {
        "cleaned": tagged,
        "cleaning_stats": clean.cleaning_stats(tagged),
        "noise_stats": noise_counts,
        "conflicts": merge.conflict_audit(keyed, conflicts),
        "near_duplicates": near,
        "merged": merged,
        "rejected": rejected,
        "splits": splits,
        "merge_statistics": merge_stats,
        "class_weights": sampling.class_weights(merged),
        "checks": checks,
    }


def build_legacy(unified: DataFrame, steps: tuple[clean.Step, ...] = clean.OLDER_STEPS, language: str | None = "en",
                 split: Split = Split(), oversample_train: bool = True) -> DataFrame:
    """The older flow: older cleaner over all rows, conflicting texts dropped, shuffle split.

    Conflicts are found before duplicates fall away, and the training part is oversampled only after the
    split, so that no text is on both sides. Adds ``clean_text`` and ``split``.
    """
    raw = keep_first(unified.filter(~tx.is_blank(F.col("text"))), tx.fingerprint(F.col("text")))
    cleaned = materialize(clean.clean_legacy(raw, "text", steps, language).filter(F.col("clean_text") != ""), "legacy-clean")
    single = keep_first(merge.drop_conflicts(cleaned, "clean_text"), tx.fingerprint(F.col("clean_text")))
    n = split.per_class
    balanced = sampling.undersample(single, n, seed=split.seed)
    parts = materialize(sampling.shuffle_split(balanced, split), "legacy-splits")
    if n <= 0 or not oversample_train:
        return parts
    target = int(n * split.shares[0])
    train = sampling.oversample(parts.filter("split = 'train'"), target, seed=split.seed).drop("draw")
    return parts.filter("split <> 'train'").unionByName(train)
