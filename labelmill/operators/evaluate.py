"""Evaluation of a scored table.

Everything from accuracy to the classification report follows from one confusion aggregate of at most
``classes ** 2`` rows. Curves are built on distinct scores: rows are folded per (class, score) first, and the
running sums are taken inside score ranges plus the totals of the ranges before, so no class is ever
sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.config import LABEL_NAMES, LABELS
from labelmill.functions import labels as lb
from labelmill.storage import materialize

# ---------------------------------------------------------------- confusion family


def confusion_counts(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted_label", labels=LABELS) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return df.groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(F.col(predicted) == k).alias(f"pred_{k}") for k in labels]
    )


def per_class(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or as prediction; 0 where undefined."""
    cells = confusion_counts(df, label, predicted)
    hit = F.col("label") == F.col("predicted")
    as_truth = F.struct(F.col("label").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"))
    as_claim = F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                        F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"))
    sums = cells.select(F.inline(F.array(as_truth, as_claim))).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    )

    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    return sums.select(
        "label", "tp", "claimed",
        ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )


def metrics(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Accuracy, macro and support-weighted precision, recall and F1, in one row."""
    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    return per_class(df, label, predicted).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Class rows, then accuracy, macro and weighted averages."""
    classes = per_class(df, label, predicted)
    named = classes.select(lb.label_name(F.col("label")).alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support").alias("support")
    names = ("precision", "recall", "f1")
    accuracy = F.sum("tp") / F.sum("support")
    averages = classes.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in names],
        accuracy.alias("accuracy"), total,
    )
    none = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("support").alias("support")),
        *[F.struct(F.lit(title).alias("name"), *[F.col(f"{p}_{c}").alias(c) for c in names], F.col("support").alias("support"))
          for title, p in (("macro avg", "m"), ("weighted avg", "w"))],
    )
    return named.unionByName(averages.select(F.inline(rows)))


def report_text(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """The report as one text document (``text``): class lines, then the overall scores."""
    lines = classification_report(df, label, predicted).filter("precision is not null")
    body = lines.agg(
        F.array_join(F.sort_array(F.collect_list(F.format_string(
            "%s    %.2f    %.2f    %.2f    %d", "name", "precision", "recall", "f1", "support"))), "\n").alias("body")
    )
    overall = metrics(df, label, predicted).select(F.format_string(
        "Accuracy: %.4f\nPrecision (Macro): %.4f\nRecall (Macro): %.4f\nF1 (Macro): %.4f",
        "accuracy", "precision_macro", "recall_macro", "f1_macro").alias("overall"))
    return body.select(F.concat_ws("\n\n", "body", overall.scalar()).alias("text"))


# ---------------------------------------------------------------- curves

SCORE_RANGES = 256


def one_vs_rest(df: DataFrame, label: str = "label", probabilities: str = "prob", labels=LABELS) -> DataFrame:
    """``(class, positive, score)``: every row once per class."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("class"), (F.col(label) == k).alias("positive"), F.get(probabilities, F.lit(i)).alias("score"))
        for i, k in enumerate(labels)
    ])
    return df.select(F.inline(rows))


def cumulative_counts(scored: DataFrame) -> DataFrame:
    """True and false positives at every distinct score, from the highest down.

    Columns ``class, score, pos, neg, tp, fp, all_pos, all_neg``. Approximate quantiles only choose the
    score ranges, the counts are exact. The input is read once: its distinct scores are written and used from there.
    """
    points = materialize(scored.groupBy("class", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    ), "points")
    steps = F.array(*[F.lit(i / SCORE_RANGES) for i in range(1, SCORE_RANGES)])
    bounds = points.groupBy("class").agg(F.percentile_approx("score", steps, F.lit(4 * SCORE_RANGES)).alias("bounds"))
    # one row per class: small by construction
    ranged = points.join(F.broadcast(bounds), "class").withColumn(
        "range", F.size(F.filter("bounds", lambda b: b < F.col("score")))
    ).drop("bounds")
    by_class = Window.partitionBy("class")
    above = by_class.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("class", "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    offsets = totals.select(
        "class", "range",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp_above"),
        F.sum("p").over(by_class).alias("all_pos"), F.sum("n").over(by_class).alias("all_neg"),
    )
    down = Window.partitionBy("class", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, ["class", "range"]).select(
        "class", "score", "pos", "neg",
        (F.col("tp_above") + F.sum("pos").over(down)).alias("tp"),
        (F.col("fp_above") + F.sum("neg").over(down)).alias("fp"),
        "all_pos", "all_neg",
    )


def roc_points(scored: DataFrame) -> DataFrame:
    """False and true positive rate at every threshold, starting at (0, 0) above the highest score."""
    points = cumulative_counts(scored).select(
        "class", F.col("score").alias("threshold"),
        F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"),
    )
    origin = scored.select("class").distinct().select(
        "class", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_points(scored: DataFrame) -> DataFrame:
    return cumulative_counts(scored).select(
        "class", F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide("tp", "all_pos"), F.lit(1.0)).alias("recall"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve per class (trapezoids over score ties); null if a class lacks one side."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return cumulative_counts(scored).groupBy("class").agg(
        F.try_divide(area, F.max("all_pos") * F.max("all_neg").cast("double")).alias("auc")
    )


def roc_auc_within(scored: DataFrame, bins: int = 1 << 14) -> DataFrame:
    """``(class, auc, error)`` from one pass: scores from 0 to 1 fold into ``bins`` buckets per class on the map side.

    Rows of one bucket count as ties, so the true area lies within ``error`` of ``auc``: half the share of pairs that share a bucket.
    """
    bucket = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    folded = scored.groupBy("class", bucket.alias("bucket")).agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    down = Window.partitionBy("class").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    summed = folded.withColumn("tp", F.sum("pos").over(down))
    pairs = F.sum("pos") * F.sum("neg").cast("double")
    return summed.groupBy("class").agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), pairs).alias("auc"),
                                       F.try_divide(F.sum(F.col("pos") * F.col("neg") / 2), pairs).alias("error"))


def roc_auc_macro(scored: DataFrame) -> DataFrame:
    """Plain mean over the classes; 0 if the area is undefined for one of them."""
    auc = roc_auc(scored)
    return auc.agg(F.when(F.count_if(F.col("auc").isNull()) > 0, 0.0).otherwise(F.avg("auc")).alias("roc_auc_macro"))


def curve_areas(scored: DataFrame) -> DataFrame:
    """``(class, auc, average_precision)`` from the same counts, in one pass over the input."""
    pairs = F.max("all_pos") * F.max("all_neg").cast("double")
    step = F.try_divide(F.col("pos") * F.col("tp"), F.col("all_pos") * (F.col("tp") + F.col("fp")).cast("double"))
    return cumulative_counts(scored).groupBy("class").agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), pairs).alias("auc"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def average_precision(scored: DataFrame) -> DataFrame:
    step = F.try_divide(F.col("pos") * F.col("tp"), F.col("all_pos") * (F.col("tp") + F.col("fp")).cast("double"))
    return cumulative_counts(scored).groupBy("class").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


# ---------------------------------------------------------------- predictions


def enrich(df: DataFrame, label: str = "label", predicted: str = "predicted_label", probabilities: str = "prob",
           labels=LABELS) -> DataFrame:
    """Add class names, one probability column per class and the confidence."""
    return df.withColumns({
        "predicted_name": lb.label_name(F.col(predicted)),
        "true_name": lb.label_name(F.col(label)),
        **{f"prob_{LABEL_NAMES[k]}": F.get(probabilities, F.lit(i)) for i, k in enumerate(labels)},
        "confidence": F.array_max(probabilities),
    })


def misclassified(enriched: DataFrame, label: str = "label", predicted: str = "predicted_label",
                  id_cols: tuple[str, ...] = ("row_id",), top: int | None = None) -> DataFrame:
    """Wrong predictions, most confident first; ``top`` gives a bounded report."""
    wrong = enriched.filter(F.col(label) != F.col(predicted)).orderBy(F.desc("confidence"), *id_cols)
    return wrong if top is None else wrong.limit(top)
