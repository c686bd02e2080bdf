"""Balancing and splitting by hashed order.

``md5(seed || id)`` gives every row a fixed place in a random order: the same on every run, on every
cluster and after every retry, which ``rand()`` is not. Exact cuts of that order never sort a whole class
in one task: a histogram over 65,536 hash buckets finds the bucket in which the cut falls, and only
the rows of that one bucket are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.config import LABELS, Split
from labelmill.functions import text as tx

HEX_DIGITS = 4  # 16 ** 4 buckets


def draw_key(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), c.cast("string")))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, HEX_DIGITS), 16, 10).cast("int")


def _histogram(hashed: DataFrame) -> DataFrame:
    """``(_by, _b, _n, _upto, _total)``: rows per bucket, running and total count per class."""
    counts = hashed.groupBy("_by", _bucket(F.col("_h")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_by")
    return counts.withColumns({"_upto": F.sum("_n").over(by.orderBy("_b")), "_total": F.sum("_n").over(by)})


def cut_points(df: DataFrame, by: Column, id_col: str, seed: int, targets: dict[str, Column]) -> DataFrame:
    """For each class and target ``k`` (an expression over ``_total``): the largest hash among the first k rows."""
    hashed = df.select(by.alias("_by"), draw_key(id_col, seed).alias("_h")).filter(F.col("_by").isNotNull())
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.least(k.cast("bigint"), F.col("_total")).alias("k"))
                      for name, k in targets.items()])
    cuts = (
        _histogram(hashed)
        .withColumn("_t", F.explode(asked))
        .filter((F.col("_t.k") > F.col("_upto") - F.col("_n")) & (F.col("_t.k") <= F.col("_upto")))
        .select("_by", "_b", F.col("_t.name").alias("_name"),
                (F.col("_t.k") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    # one row per class and target
    edge = hashed.withColumn("_b", _bucket(F.col("_h"))).join(F.broadcast(cuts), ["_by", "_b"])
    order = Window.partitionBy("_by", "_name").orderBy("_h")
    edge = edge.withColumn("_rank", F.row_number().over(order)).filter("_rank = _need")
    return edge.groupBy("_by").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_h"))).alias(f"_cut_{name}") for name in targets]
    )


def _with_cuts(df: DataFrame, by: Column, id_col: str, seed: int, targets: dict[str, Column]) -> DataFrame:
    cuts = cut_points(df, by, id_col, seed, targets)
    tagged = df.withColumns({"_by": by, "_h": draw_key(id_col, seed)})
    return tagged.join(F.broadcast(cuts), "_by", "left")  # one row per class


def _with_global_cuts(df: DataFrame, id_col: str, seed: int, targets: dict[str, Column]) -> DataFrame:
    """The same over the whole table: each cut is one number, read by a scalar subquery."""
    cuts = cut_points(df, F.lit(0), id_col, seed, targets)
    return df.withColumn("_h", draw_key(id_col, seed)).withColumns(
        {f"_cut_{name}": cuts.agg(F.max(f"_cut_{name}")).scalar() for name in targets}
    )


def _in_domain(label: str, labels) -> Column:
    """The class, or null outside the fixed domain: bounds the number of classes and so of cut rows."""
    return F.when(F.col(label).isin(*labels), F.col(label))


def rejected_labels(df: DataFrame, label: str = "label", labels=LABELS) -> DataFrame:
    """The rows that balancing and splitting leave out: label null or outside the domain."""
    return df.filter(~F.coalesce(F.col(label).isin(*labels), F.lit(False)))


def undersample(df: DataFrame, n: int, label: str = "label", id_col: str = "row_id", seed: int = 42,
                labels=LABELS) -> DataFrame:
    """Exactly ``n`` rows of each larger class and all rows of the others; ``n <= 0`` keeps everything.

    Rows whose label is outside ``labels`` are in no class and not in the result: see :func:`rejected_labels`.
    """
    if n <= 0:
        return df
    out = _with_cuts(df, _in_domain(label, labels), id_col, seed, {"n": F.lit(n)})
    return out.filter(F.col("_h") <= F.col("_cut_n")).select(*df.columns)


def presample(df: DataFrame, n: int, factor: int = 3, **kw) -> DataFrame:
    """Candidate pool before a costly step: ``factor * n`` rows per class."""
    return undersample(df, n * factor, **kw)


def random_subset(df: DataFrame, n: int, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows."""
    out = _with_global_cuts(df, id_col, seed, {"n": F.lit(n)})
    return out.filter(F.col("_h") <= F.col("_cut_n")).select(*df.columns)


def with_rank(df: DataFrame, id_col: str = "row_id", seed: int = 42, by: Column | None = None,
              out: str = "position") -> DataFrame:
    """Exact 1-based place of each row in the hashed order, per class if ``by`` is given.

    Rank = rows in earlier buckets + place within the bucket; both use one shuffle by (class, bucket).
    """
    tagged = df.withColumns({"_by": by if by is not None else F.lit(0), "_h": draw_key(id_col, seed)})
    offsets = _histogram(tagged.select("_by", "_h")).select("_by", "_b", (F.col("_upto") - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_by", "_b").orderBy("_h"))
    ranked = tagged.withColumn("_b", _bucket(F.col("_h"))).join(offsets, ["_by", "_b"])
    return ranked.withColumn(out, F.col("_before") + place).select(*df.columns, out)


def shuffled(df: DataFrame, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """The whole table in random order (a distributed range sort)."""
    return df.orderBy(draw_key(id_col, seed))


def oversample(df: DataFrame, n: int, label: str = "label", id_col: str = "row_id", seed: int = 42,
               labels=LABELS) -> DataFrame:
    """Exactly ``n`` rows per class present: larger classes are cut, smaller ones drawn with replacement.

    Adds ``draw`` (0 for rows taken once). Split first and oversample the training part only, or copies of
    one text end up on both sides.
    """
    by = _in_domain(label, labels)
    sizes = df.groupBy(by.alias("_by")).agg(F.count(F.lit(1)).alias("_size")).filter("_by is not null")
    small = sizes.filter(F.col("_size") < n)
    cut = (
        undersample(df, n, label, id_col, seed, labels)
        .join(F.broadcast(small.select(F.col("_by").alias(label))), label, "left_anti")
        .withColumn("draw", F.lit(0).cast("bigint"))
    )
    spark = df.sparkSession
    k = len(labels)
    classes = F.array(*[F.lit(x) for x in labels])
    draws = spark.range(n * k).select(
        F.get(classes, F.pmod("id", F.lit(k)).cast("int")).alias("_by"),
        F.floor(F.col("id") / k).cast("bigint").alias("draw"),
    )
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_by", "draw")), 1, 8), 16, 10).cast("bigint")
    draws = draws.join(F.broadcast(small), "_by").select("_by", "draw", (F.pmod(pick, F.col("_size")) + 1).alias("position"))
    drawn_from = df.join(F.broadcast(small.select(F.col("_by").alias(label))), label, "left_semi")
    numbered = with_rank(drawn_from, id_col, seed, F.col(label)).withColumn("_by", F.col(label))
    drawn = numbered.join(draws, ["_by", "position"]).select(*df.columns, "draw")
    return cut.select(*df.columns, "draw").unionByName(drawn)


def stratified_split(df: DataFrame, cfg: Split = Split(), label: str = "label",
                     id_col: str = "row_id", labels=LABELS) -> DataFrame:
    """Add ``split`` (train, validation, test) with the same proportions in every class.

    Shares are scaled to sum to one; the cuts of a class of n rows are ``round(n * share)``. Rows whose label is outside
    ``labels`` get no split: see :func:`rejected_labels`.
    """
    whole = sum(cfg.shares)
    train, upto_val = cfg.shares[0] / whole, (cfg.shares[0] + cfg.shares[1]) / whole
    total = F.col("_total").cast("double")
    targets = {"train": F.round(total * train), "val": F.round(total * upto_val)}
    out = _with_cuts(df, _in_domain(label, labels), id_col, cfg.seed, targets)
    return out.filter(F.col("_by").isNotNull()).withColumn("split", _split_name()).select(*df.columns, "split")


def shuffle_split(df: DataFrame, cfg: Split = Split(), id_col: str = "row_id") -> DataFrame:
    """Cut the hashed order of the whole table: ``int(n * ratio)`` rows each, the last part takes the rest."""
    if abs(sum(cfg.shares) - 1.0) >= 1e-9:
        raise ValueError("split ratios must sum to 1")
    total = F.col("_total").cast("double")
    train = F.floor(total * cfg.shares[0])
    targets = {"train": train, "val": train + F.floor(total * cfg.shares[1])}
    out = _with_global_cuts(df, id_col, cfg.seed, targets)
    return out.withColumn("split", _split_name()).select(*df.columns, "split")


def _split_name() -> Column:
    return (
        F.when(F.col("_h") <= F.col("_cut_train"), "train")
        .when(F.col("_h") <= F.col("_cut_val"), "validation")
        .otherwise("test")
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share in percent per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per class
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``total / (classes * count)`` over the classes present, 4 decimals."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.partitionBy()  # over one row per class
    return counts.withColumn(
        "weight", F.round(F.sum("n").over(all_rows) / (F.count(F.lit(1)).over(all_rows) * F.col("n")), 4)
    )


def class_weights_fixed(df: DataFrame, label: str = "label", labels=LABELS) -> DataFrame:
    """The same for a fixed number of classes; a class without rows weighs 1.0."""
    sums = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(label) == k).alias(f"_n{k}") for k in labels])
    rows = F.array(*[F.struct(F.lit(k).alias(label), F.col(f"_n{k}").alias("n"), F.col("_total").alias("total"))
                     for k in labels])
    weight = F.coalesce(F.try_divide(F.col("total"), F.lit(len(labels)) * F.col("n")), F.lit(1.0))
    return sums.select(F.inline(rows)).select(label, "n", weight.alias("weight"))


SPLITS = ("train", "validation", "test")


def split_metadata(df: DataFrame, split: str = "split", label: str = "label", labels=LABELS) -> DataFrame:
    """Rows in all and per class for every split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(label) == k).alias(f"label_{k}") for k in labels]
    )


def leakage(df: DataFrame, text: str = "text", split: str = "split", splits=SPLITS) -> DataFrame:
    """Distinct texts common to each pair of splits, in one shuffle of text digests."""
    seen = df.groupBy(tx.fingerprint(F.col(text)).alias("_key")).agg(
        *[F.max(F.col(split) == s).alias(f"_{s}") for s in splits]
    )
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    sums = seen.agg(*[F.count_if(F.col(f"_{a}") & F.col(f"_{b}")).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"{a}_{b}").alias("overlap")) for a, b in pairs])
    return sums.select(F.inline(rows))
