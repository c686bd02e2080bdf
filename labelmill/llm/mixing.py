"""Mixing sources to target weights: exact block quotas, split among output shards by a tree.

Every source is cut into blocks by a hash of the document id, so blocks are disjoint and permuted. A source's target is
met block by block (a second pass over the source follows when the target exceeds its size); the boundary block is cut at a
document and that document at a word. The numbers of blocks drawn, one for each source, are then split among the output
shards: each node of a binary tree draws its left share from the multivariate hypergeometric distribution, so every shard
gets an exact and random composition without any shuffle of all blocks. Within a shard, ``position`` orders the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import count_words, materialize, Carried, whole

WEIGHTS = (3.0, 1.0, 2.0)
BLOCKS = 256


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """``(source, source_size)`` with ``target``; one row for each source, so windows over all rows are small.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all words by weight; a target stops at
    ``repeat`` times its source's size and the excess is shared again, which ends at ``min(cap, level * weight)``.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    weighed = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(repeat))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / rest)
    # The first source, by cap over weight, that stays at or below its cap sets the level; if there is none, all are full.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)
    return (level.withColumn("_fits", fits["level"])
            .select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("_fits") * F.col("weight"), F.col("cap"))).alias("target")))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**52)).cast("double") / F.lit(float(2**52))


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """A draw of how many of ``good`` among ``total`` are in a sample of ``drawn``: inverts the distribution at ``u``.

    Logarithms of the weights are added up from the smallest possible value and scaled by the largest.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn + good - total)
    high = F.least(good, drawn)

    def grow(acc, x):
        ratio = F.log((good - x + 1).cast("double") * (drawn - x + 1).cast("double") / (x.cast("double") * (total - good - drawn + x).cast("double")))
        last = acc["at"] + ratio
        return F.struct(last.alias("at"), F.concat(acc["all"], F.array(last)).alias("all"))

    first = F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("all"))
    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    logs = F.aggregate(steps, first, grow, lambda a: a["all"])
    scaled = _let(logs, lambda l: _let(F.array_max(l), lambda top: F.transform(l, lambda v: F.exp(v - top))))

    def invert(weights):
        aim = u * F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return _let(aim, lambda goal: F.aggregate(weights, start, lambda a, w: F.struct(
            (a["sum"] + w).alias("sum"), (a["below"] + F.when(a["sum"] + w <= goal, 1).otherwise(0)).cast("long").alias("below")), lambda a: a["below"]))

    return F.least(low + _let(scaled, invert), high)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """``(source, quota)`` split among ``shards`` (a power of two): ``(source, shard, quota, before)``.

    ``before``: quota of the same source in earlier shards. A node of the tree is one row with an array of one number for each source; a level
    draws one source after another, each from what the earlier ones left.
    """
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("the number of shards must be a power of two")
    every = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").cast("long").alias("quota")))).alias("q"))
    node = every.select(F.lit(0).cast("long").alias("shard"), F.transform("q", lambda x: x["source"]).alias("sources"), F.transform("q", lambda x: x["quota"]).alias("q"))
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("total"), F.floor((total + 1) / 2).cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        at = F.lit(level)

        def draw(acc, x):
            u = _uniform(F.lit(seed), at, F.col("shard"), F.size(acc["left"]))  # noqa: B023 - used at once
            return _let(_hypergeometric(x, acc["total"], acc["drawn"], u), lambda taken: F.struct(
                (acc["total"] - x).alias("total"), (acc["drawn"] - taken).alias("drawn"), F.concat(acc["left"], F.array(taken)).alias("left")))

        drawn = node.select("shard", "sources", "q", F.aggregate("q", start, draw, lambda a: a["left"]).alias("left"))
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")),
                         F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))
        node = drawn.select("sources", F.explode(halves).alias("h")).select("sources", "h.shard", "h.q")
    flat = node.select("shard", F.explode(F.arrays_zip("sources", "q")).alias("x")).select(F.col("x.sources").alias("source"), "shard", F.col("x.q").alias("quota"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("before", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = 1.5, repeat: float = 2.0, shards: int = 16, seed: int = 7) -> DataFrame:
    """For each row of ``docs``: the words taken in the first and second pass (``t1``, ``t2``) and the shards that get them."""
    if repeat > 2:
        raise ValueError("at most two passes over a source")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(whole(text_col)).alias("size"),
                         F.xxhash64(F.lit(seed), F.col(id_col), whole(text_col)).alias("order"))
    narrow = materialize(narrow.withColumn("block", F.pmod(F.shiftright("order", 40), F.lit(BLOCKS))), "mix-sizes")
    blocks = materialize(narrow.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")  # BLOCKS rows a source at most
    aims = materialize(targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeat), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    in_order = Window.partitionBy("source").orderBy("block")
    ranked = blocks.select("source", "block", "words", F.row_number().over(in_order).alias("rank"),
                           (F.sum("words").over(in_order) - F.col("words")).alias("before"), F.count("*").over(Window.partitionBy("source")).alias("of"))
    b, a = ranked.alias("b"), aims.alias("a")
    whole_words = F.floor(F.col("a.target")).cast("long")
    first = F.least(whole_words, F.col("a.source_size"))
    cut = [("1", first), ("2", whole_words - first)]
    placed = b.join(a, same(ranked, aims)).select(
        "b.source", "b.block", "b.words", "b.rank", "b.of", "b.before", "a.source_size", "a.target",
        *[F.greatest(F.lit(0).cast("long"), F.least(F.col("b.words"), goal - F.col("b.before"))).alias(f"take{n}") for n, goal in cut])
    placed = materialize(placed, "mix-placed")
    quotas = placed.groupBy("source").agg((F.count(F.when(F.col("take1") > 0, 1)) + F.count(F.when(F.col("take2") > 0, 1))).alias("quota"))
    tree = materialize(split_quotas(quotas, shards, seed), "mix-tree")
    # Blocks drawn, in order of pass and block, fill the shards' quotas one after another.
    drawn = [placed.where(F.col(f"take{n}") > 0).select("source", "block", F.lit(n).alias("pass")) for n in (1, 2)]
    lined = reduce(DataFrame.unionByName, drawn).withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "pass", "block")))
    l, t = lined.alias("l"), tree.alias("t")
    homes = (l.join(t, same(lined, tree) & (F.col("l.turn") > F.col("t.before")) & (F.col("l.turn") <= F.col("t.before") + F.col("t.quota")))
             .groupBy("l.source", "l.block").agg(F.max(F.when(F.col("l.pass") == 1, F.col("t.shard"))).alias("shard1"), F.max(F.when(F.col("l.pass") == 2, F.col("t.shard"))).alias("shard2")))
    p, h = placed.alias("p"), homes.alias("h")
    plan = p.join(h, same(placed, homes) & (F.col("p.block") == F.col("h.block")), "left").select(
        F.col("p.source").alias("plan_source"), F.col("p.block").alias("plan_block"), "p.words", "p.source_size", "p.target", "p.take1", "p.take2", "h.shard1", "h.shard2")
    plan = materialize(plan, "mix-plan")
    rows = narrow.join(plan, narrow["source"].eqNullSafe(plan["plan_source"]) & (narrow["block"] == plan["plan_block"]))
    split_block = lambda n: (F.col(f"take{n}") > 0) & (F.col(f"take{n}") < F.col("words"))
    # Only the blocks in which a target falls (two a source at most) are ordered; all others are taken whole or not at all.
    edge = rows.where(split_block(1) | split_block(2))
    in_block = Window.partitionBy("plan_source", "plan_block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("above", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    inner = rows.where(~(split_block(1) | split_block(2))).withColumn("above", F.lit(0).cast("long"))
    part = lambda n: F.when(F.col(f"take{n}") == F.col("words"), F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col(f"take{n}") - F.col("above"))))
    out = inner.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", "order", part(1).alias("t1"), part(2).alias("t2"), "shard1", "shard2")
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, taken, shards, position``.

    ``size``: words of the whole text. ``taken``: words the mix takes of it, repeats counted, never more than ``repeat`` (2 at
    most) times its size; over a source they add up to its target, rounded down. ``shards``: the output shards that get it,
    one for each pass in which it is drawn. Null text: size 0, never taken. Null source: a source of its own, last. Null ids and
    repeated rows are documents like others (equal rows share a place in the order). No rows: no rows. Options are those of
    :func:`draws`. Same input, same result.
    """
    shards_of = F.filter(F.array(F.when(F.col("t1") > 0, F.col("shard1")), F.when(F.col("t2") > 0, F.col("shard2"))), lambda s: s.isNotNull())
    return draws(docs, **options).select("doc_id", "source", "size", "source_size", "target", (F.col("t1") + F.col("t2")).alias("taken"),
                                         shards_of.alias("shards"), F.xxhash64(F.lit(1), "order").alias("position"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, one for each time they are drawn.

    Further columns: ``size`` (words of the whole text), ``target`` (its source's), ``taken`` (words of this draw), ``shard`` and
    ``position`` in it; columns of these names are replaced. The document at a target's edge ends behind its last word taken. Rows
    with equal id, text and source are drawn from one of them. Null and empty texts are never drawn; a null source is a source of
    its own, null ids are ids like others. No rows: no rows.
    """
    plan = draws(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    turns = F.filter(F.array(F.struct(F.col("t1").alias("n"), F.col("shard1").alias("shard")), F.struct(F.col("t2").alias("n"), F.col("shard2").alias("shard"))), lambda t: t["n"] > 0)
    # One key of one type for the first of equal rows and for the join, so that texts are shuffled once; nulls within a struct are equal.
    # Without the cast the fields differ in whether they may be null, and the join would cast them and shuffle again.
    kind = f"struct<s:{docs.select(source_col).schema[0].dataType.simpleString()},o:bigint>"
    key = lambda source, order: F.struct(source.alias("s"), order.alias("o")).cast(kind)
    plan = plan.select(key(F.col("source"), F.col("order")).alias("_drawn"), F.col("size").alias("_size"), F.col("target").alias("_target"),
                       F.explode(turns).alias("_turn"))
    rest = Carried(docs, "shard", "position", "size", "target", "taken", text_col)
    mine = key(F.col(source_col), F.xxhash64(F.lit(seed), F.col(id_col), whole(text_col)))
    held = docs.select(*rest.cols, F.col(text_col).alias("_text"), mine.alias("_mine"))
    joined = held.dropDuplicates(["_mine"]).join(plan, F.col("_mine") == F.col("_drawn"))
    cut = F.array_join(F.slice(F.split("_text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_turn.n").cast("int")), "")
    text = F.when(F.col("_turn.n") < F.col("_size"), cut).otherwise(F.col("_text"))
    return joined.select(*rest.back(), text.alias(text_col), F.col("_size").alias("size"), F.col("_target").alias("target"), F.col("_turn.n").alias("taken"),
                         F.col("_turn.shard").alias("shard"), F.xxhash64(F.lit(1), "_mine.o", "_turn.shard").alias("position"))
