"""Near duplicates by bottom-k sketches of one hash function.

1. Each text becomes the set of hashes of its shingles; equal sets fold into the smallest id (exact copies cost no pairs).
   A set's sketch is its ``K`` smallest hashes: both a uniform sample of the set and a prefix of it in one global order.
2. Inverted lists of retained values. First each list is compared with a few heads only (stars): that is linear and
   gathers large groups of copies, whose further pairs are then superfluous. Lists that are still held by many groups are
   common shingles: they go to the end of the order, rarest first, and are met only by sets that have too few other values.
3. Lists that many sets keep in their prefixes are families. The sets of a family, and two groups with many candidates between them, are dealt into
   blocks and compared block against block in one task each, which returns only links that join groups: rows grow with the blocks, not
   with the pairs. Other pairs of different groups that share two values or more meet over a list that few sets keep, or, if they share only lists
   that many keep, in blocks of sketches, and are filtered by the union sketch, far below the similarity asked for. A block pair lists
   its candidates, each at one shared value only, while they are no more than its sets; beyond that it names the sets, whose full values are then compared in blocks. By the
   prefix argument no similar pair shares fewer: sets whose partners have no more than ``K`` values certainly, larger ones but for a
   chance below ``CHANCE``. In hash order that is so from ``prefix`` values on (:func:`bounds`). Where common values were moved back, the sketches of a pair
   that passes the filter share ``least`` values, so at most ``K - least`` others stand before the second shared one: ``K - least + 2`` values.
4. The full sets of what is left are compared; links become components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.bytesops import hash_words, shingles
from labelmill.llm.common import materialize, small, whole, Carried
from labelmill.llm.graph import components

K = 32           # retained values of a set
CHANCE = 1e-9    # with which a bound may fail for a pair
HOT_GROUPS = 16  # a value held by more groups is a common shingle
HEADS, ROUNDS = 4, 2
FAMILY = 64      # sets that keep a value in their prefixes and so are compared in blocks
FAMILIES = 3     # of these values, how many a set is dealt by
BLOCK_SETS, BLOCK_VALUES = 512, 500_000
WIDE_SETS = 4096  # sketches in a block
PAIR_ROWS = 64   # candidates between two groups that are compared one by one; more are compared in blocks
BROADCAST_ROWS = 2_000_000


def bounds(percent: int) -> tuple[int, int]:
    """``(prefix, least)``: values of a random order of which similar sets share two, and values of the union sketch that they share."""
    p = percent / 100
    below = lambda n, m: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m))
    least = max(m for m in range(K + 1) if below(K, m) < CHANCE)
    if least < 2:
        raise ValueError(f"sketches of {K} values are too small for a similarity of {percent} percent")
    return min(n for n in range(2, K + 1) if below(n, 2) < CHANCE), least


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles(hash_words((text or "").encode("utf-8", "surrogatepass").lower()), width).view(np.int64))


def _sketches(width: int, k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, digests, sketches = [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), width)
                n.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketches.append(values[:k])
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if n else np.zeros((0, 2), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]),
                                   pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return run


def _compare(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last, kept = None, None
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"))):
                if a != last:  # rows come sorted by a in runs: its set is made once
                    last, kept = a, shingle_set(x.as_py(), width)
                other = shingle_set(y.as_py(), width)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    keep.append(i)
            yield pa.record_batch([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], schema=schema)

    return run


def estimate(x: Column, y: Column, k: int) -> Column:
    """Share of the ``k`` smallest values of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b, ...)`` whose sizes and union sketch allow the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return joined.where(fits & (estimate(F.col("sa"), F.col("sb"), K) >= bounds(percent)[1] / K)).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full sets are similar enough."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    ids = F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids
    some = materialize(texts.join(ids, "id").groupBy("id").agg(F.min("text").alias("text")), "near-texts")
    joined = (pairs.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
              .join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b"))
    return materialize(joined.mapInArrow(_compare(width, percent), "a long, b long"), "near-links")


def _stars(lists: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a set with heads of its lists: those tested, and those that are links.

    A list's heads are its most central set, its smallest id and the ids with the smallest hashes by several hashes, so that
    the lists of one group of copies agree on them. Sets that only come near a head try others in further rounds. Rounds
    only save work: pairs left are found later.
    """
    tested = links = None
    near = lists
    for turn in range(ROUNDS):
        heads = near.groupBy("v").agg(F.max(F.struct("central", "id"))["id"].alias("h0"), F.min("id").alias("h1"),
                                      *[F.min(F.struct(F.xxhash64(F.lit(turn * HEADS + i), "id"), "id"))["id"].alias(f"h{i}") for i in range(2, HEADS)])
        heads = heads.select("v", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("head"))
        trying = near if turn == 0 else near.where("open")
        pairs = trying.join(heads, "v").where("id <> head").groupBy("id", "head").agg(F.count("*").alias("shared")).where("shared >= 4")
        best = (pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("shared", "head")), asc=False).alias("all"))
                .select("id", F.explode(F.slice("all", 1, HEADS)).alias("h")).select(F.least("id", "h.head").alias("a"), F.greatest("id", "h.head").alias("b"), F.col("id").alias("own")))
        best = materialize(best, "near-stars")
        fresh = best.select("a", "b").distinct()
        fresh = fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti")
        fresh = materialize(_similar(fresh, sets, percent), "near-stars")
        found = _verified(fresh, texts, width, percent)
        tested = fresh if tested is None else materialize(tested.union(fresh), "near-tested")
        links = found if links is None else materialize(links.union(found), "near-links")
        if turn == ROUNDS - 1:
            break
        ends = lambda df: df.select(F.col("a").alias("id")).union(df.select("b"))
        # Open: came near a head by its sketch, but is an end of no link.
        close = ends(tested).distinct().join(ends(links).distinct(), "id", "left_anti")
        close = materialize(close, "near-open")
        if small(close, HOT_GROUPS):
            break
        of_open = lists.join(close, "id", "left_semi").select("v").distinct()
        near = materialize(lists.join(of_open, "v", "left_semi").join(close.withColumn("open", F.lit(True)), "id", "left").withColumn("open", F.coalesce("open", F.lit(False))), "near-lists")
    return tested, links


def _parts(sized: DataFrame, by: list[str], most: int) -> DataFrame:
    """``sized (*by, id, n)`` with ``part`` and ``parts``: each group dealt into blocks of a bounded number of sets and values."""
    count = sized.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / BLOCK_VALUES)).cast("int").alias("parts"))
    return sized.join(count, by).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "id"), "parts").cast("int"))


def _in_families(family: DataFrame, sets: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``(task, right, id, g)``: each block of a family on the left of a task with itself and with each later block on the right."""
    members = family.select("id", F.explode("family").alias("f")).join(sets.select("id", "n"), "id").join(groups, "id", "left").select("f", "id", "n", F.coalesce("g", "id").alias("g"))
    dealt = _parts(members, ["f"], most)
    upto = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.least("part", i).alias("x"), F.greatest("part", i).alias("y"), (i < F.col("part")).cast("int").alias("right")))
    return dealt.withColumn("t", F.explode(upto)).select(F.struct(F.col("f").alias("k1"), F.lit(-1).cast("long").alias("k2"), "t.x", "t.y").alias("task"), "t.right", "id", "g")


def _between_sides(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """``(task, right, id, g)``: blocks of the left sets of ``marked (k1, k2, right, id, g)`` against blocks of the right sets of the same keys."""
    dealt = _parts(marked.select("k1", "k2", "right", "id", "g").join(sets.select("id", "n"), "id"), ["k1", "k2", "right"], BLOCK_SETS)
    other = dealt.select("k1", "k2", (1 - F.col("right")).alias("right"), F.col("parts").alias("others")).distinct()
    each = dealt.join(other, ["k1", "k2", "right"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    left = F.col("right") == 0
    return each.select(F.struct("k1", "k2", F.when(left, F.col("part")).otherwise(F.col("i")).alias("x"),
                                F.when(left, F.col("i")).otherwise(F.col("part")).alias("y")).alias("task"), "right", "id", "g")


def _narrow_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)``, and their groups, of different groups and families in ``entries (id, g, v, n, family, wide)`` that share a value, and a second or a wide one.

    A value has fewer than ``FAMILY`` entries here, so the pairs grow with the entries, whatever the groups.
    """
    x, y = entries.alias("x"), entries.alias("y")
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.g") != F.col("y.g")) & fits & ~F.arrays_overlap("x.family", "y.family"))
    both = F.size(F.array_intersect("x.wide", "y.wide"))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.g").alias("g"), F.col("y.g").alias("h"), both.alias("both"))
    shared = pairs.groupBy("a", "b", "g", "h").agg((F.count("*") + F.max("both")).alias("shared"))
    return materialize(shared.where("shared >= 2").select("a", "b", "g", "h"), "near-narrow")


def _wide_pairs(family: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)``, and their groups, of different groups and families that share two wide values and may be similar by their sketches; and sets
    ``(k1, k2, right, id, g)`` of which those on the left may be similar to those on the right, where pairs would be more than sets.

    Sets that share two of them share one that is not the most held of either, so each is dealt by all but that. Sketches are compared block against block.
    """
    dealt = family.where(F.size("wide") > 1).select("id", F.slice("wide", 2, K).alias("family"))
    tasks = materialize(_in_families(dealt, sets.select("id", F.least("n", F.lit(K)).alias("n")), groups, WIDE_SETS), "near-wide")
    told = tasks.join(sets.select("id", "n", "sketch"), "id").join(family.select("id", "family", F.slice("wide", 2, K).alias("wide")), "id")
    cols = ("task", "id", "g", "n", "sketch", "family", "wide")
    right = told.where("right = 1").select(*[F.col(c).alias(f"{c}_") for c in cols])
    made = told.where("right = 0").select(*cols).groupBy("task").cogroup(right.groupBy("task_")).applyInArrow(_near_sketches(percent), NEAR)
    made = materialize(made, "near-wide")
    return made.where("right IS NULL").select("a", "b", "g", "h"), made.where("right IS NOT NULL").select("k1", "k2", "right", F.col("a").alias("id"), "g")


def _values(width: int):
    schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t.as_py(), width) for t in batch.column(1)], pa.list_(pa.int64()))], schema=schema)

    return run


def _overlaps(lists: pa.ListArray):
    """A function that tells how many of some distinct values each of ``lists`` holds."""
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    known, codes = np.unique(flat, return_inverse=True)
    by = np.argsort(codes, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(known)))])
    owner = np.repeat(np.arange(len(lists)), np.diff(ends))[by]

    def count(values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, values)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == values)]
        return np.bincount(np.concatenate([owner[start[j]: start[j + 1]] for j in at]), minlength=len(lists)) if len(at) else np.zeros(len(lists), np.int64)

    return count


NEAR = "a long, b long, g long, h long, right int, k1 long, k2 long"


def _near_sketches(percent: int):
    """Pairs of two blocks' sets whose sizes, and values that both sketches hold, allow the similarity; or, if they outnumber the sets, the sets that have such pairs.

    Only the task of the least of the shared values that both are dealt by tells of a pair.
    """
    least = bounds(percent)[1]
    names = [part.split(" ")[0] for part in NEAR.split(", ")]
    schema = pa.schema([(name, pa.int32() if name == "right" else pa.int64()) for name in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[]] * len(names), schema=schema)
        task = left.column("task")[0].as_py()
        alone = not right.num_rows  # a block against itself
        right = left if alone else right.rename_columns(left.column_names)
        lists = right.column("sketch").combine_chunks()
        held, size = _overlaps(lists), lists.value_lengths().to_numpy()
        ids, labels, n = (right.column(c).to_numpy() for c in ("id", "g", "n"))
        families, wides = ([set(f) for f in right.column(c).to_pylist()] for c in ("family", "wide"))
        most = left.num_rows if alone else left.num_rows + right.num_rows
        pairs, sides, count = [], ({}, {}), 0
        for a, g, m, values, family, wide in zip(*[left.column(c).to_pylist() for c in ("id", "g", "n")], left.column("sketch"), *[left.column(c).to_pylist() for c in ("family", "wide")]):
            values, wide = values.values.to_numpy(), set(wide)
            both = held(values)
            near = (K * both >= least * np.minimum(K, len(values) + size - both)) & (labels != g) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            for j in np.flatnonzero(near & (ids > a) if alone else near):
                if families[j].isdisjoint(family) and min(wides[j] & wide) == task["k1"]:
                    b, h = int(ids[j]), int(labels[j])
                    sides[0][a], sides[1][b], count = g, h, count + 1
                    if count <= most:
                        pairs.append((a, b, g, h, None, None, None) if a < b else (b, a, h, g, None, None, None))
        if count > most:  # k2: this pair of blocks, as no group has it
            pairs = [(x, None, g, None, side, task["k1"], -2 - (task["x"] << 20) - task["y"]) for side in (0, 1) for x, g in sides[side].items()]
        return pa.table([pa.array([row[i] for row in pairs], kind) for i, kind in enumerate(schema.types)], schema=schema)

    return run


def _joining_links(percent: int):
    """Links between the sets of two blocks that join groups not joined yet in this task."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns(["task", "id", "g", "set"]) if right.num_rows else left  # without right sets a block against itself
        lists = right.column("set").combine_chunks()
        held = _overlaps(lists)
        size, ids, labels = lists.value_lengths().to_numpy().astype(np.int64), right.column("id").to_numpy(), right.column("g").to_numpy()
        root = {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        found = []
        for i, (a, g, values) in enumerate(zip(left.column("id").to_pylist(), left.column("g").to_pylist(), left.column("set"))):
            values = values.values.to_numpy()
            both = held(values)
            near = (100 * both >= percent * (len(values) + size - both)) & (labels != g)
            for j in np.flatnonzero(near):
                x, y = top(g), top(int(labels[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((min(a, int(ids[j])), max(a, int(ids[j]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _blocks_compared(tasks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the groups of ``tasks (task, right, id, g)``; a task compares its left sets with its right ones, or, without these, with themselves."""
    tasks = materialize(tasks, "near-tasks")
    ids = materialize(tasks.select("id").distinct(), "near-ids")
    ids = F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids
    some = texts.join(ids, "id").groupBy("id").agg(F.min("text").alias("text"))
    sets = materialize(some.mapInArrow(_values(width), "id long, set array<long>"), "near-values")
    told = tasks.join(sets, "id")
    right = told.where("right = 1").select(*[F.col(c).alias(f"{c}_") for c in ("task", "id", "g", "set")])
    made = told.where("right = 0").select("task", "id", "g", "set").groupBy("task").cogroup(right.groupBy("task_")).applyInArrow(_joining_links(percent), "a long, b long")
    return materialize(made, "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row: the components of texts whose shingle sets are similar.

    Words are runs without ASCII white space, A-Z lower-cased; the set holds the distinct runs of ``width`` words, with fewer
    words the whole sequence, and is empty without words. Two texts are linked when ``100 * intersection >= percent * union``.
    ``component_id`` is the smallest id reachable. Null or empty texts are linked with nothing and kept. A null id is linked
    with nothing, has no component, and is kept. Rows that repeat an id are one document, judged by the text
    with the smaller digest. No rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    sets = materialize(texts.mapInArrow(_sketches(width, K), "id long, n long, d1 long, d2 long, sketch array<long>"), "near-sets")
    filled = sets.where("n > 0 AND id IS NOT NULL")
    first = materialize(filled.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "near-equal")
    # The most similar different sets hold n and n + 1 values, n of them shared: smaller ones can only be equal, which folding has settled.
    reps = (filled.where(100 * F.col("n") >= percent * (F.col("n") + 1)).join(first.select(F.col("rep").alias("id")).distinct(), "id")
            .groupBy("id").agg(F.min(F.struct("d1", "d2", "n", "sketch")).alias("s")).select("id", "s.n", "s.sketch"))
    reps = materialize(reps, "near-reps")
    rows = reps.select("id", "n", F.posexplode("sketch").alias("pos", "v"))
    held_twice = rows.groupBy("v").agg(F.count("*").alias("held")).where("held > 1")
    # Central: a text others were copied from shares all its values with them, a copy has some of its own.
    lists = rows.join(held_twice, "v").withColumn("central", F.sum("held").over(Window.partitionBy("id"))).drop("held")
    lists = materialize(lists, "near-lists")
    tested, star_links = _stars(lists, reps, texts, width, percent)
    groups = components(star_links).select("id", F.col("label").alias("g"))
    groups = materialize(groups, "near-groups")
    grouped = materialize(lists.join(groups, "id", "left").select("v", "id", "n", "pos", F.coalesce("g", "id").alias("g")), "near-grouped")
    many = grouped.select("v", "g").distinct().groupBy("v").agg(F.count("*").alias("groups"))
    marked = grouped.join(many.where(F.col("groups") > 1), "v").select("v", "id", "n", "pos", "g", (F.col("groups") > HOT_GROUPS).alias("hot"), "groups")
    # A set's order: other values by hash, then common ones, rarest first. Values with one holder are not in the lists but count.
    per_set = marked.groupBy("id", "n", "g").agg(F.collect_list(F.struct("hot", "pos", "v", "groups")).alias("all"))
    hot = F.array_sort(F.transform(F.filter("all", lambda r: r["hot"]), lambda r: F.struct(r["groups"], r["pos"])))
    ranked = F.transform("all", lambda r: F.struct(
        F.when(r["hot"], F.least("n", F.lit(K)) - F.size("hot") + F.array_position("hot", F.struct(r["groups"], r["pos"])) - 1)
        .otherwise(r["pos"] - F.size(F.filter("hot", lambda h: h["pos"] < r["pos"]))).alias("rank"), r["v"].alias("v")))
    prefix, least = bounds(percent)
    exact = F.floor(F.col("n") * (100 - percent) / 100) + 2
    moved = (F.size("hot") > 0) & (100 * F.col("n") > K * percent)  # and partners may have more values than are retained
    reach = F.when(moved, F.lit(K - least + 2)).otherwise(F.least(exact, F.lit(prefix)))
    short = (per_set.withColumn("hot", hot).select("id", "g", "n", F.explode(F.filter(ranked, lambda r: r["rank"] < reach)).alias("r"))
             .select("id", "g", "n", F.col("r.v").alias("v")))
    short = materialize(short, "near-short")
    # Values that many sets keep deal them into families, which are compared in blocks; pairs of one family don't meet here.
    wide = short.groupBy("v").agg(F.count("*").alias("held")).where(F.col("held") >= FAMILY)
    in_wide = short.join(wide, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("held", "v")), asc=False)["v"].alias("wide"))
    family = materialize(in_wide.select("id", F.slice("wide", 1, FAMILIES).alias("family"), "wide"), "near-family")
    none = F.array().cast("array<long>")
    short = materialize(short.join(family, "id", "left").select("id", "g", "v", "n", F.coalesce("family", none).alias("family"), F.coalesce("wide", none).alias("wide")), "near-short")
    narrow = _narrow_pairs(short.where(~F.array_contains("wide", F.col("v"))), percent)
    broad, crowded = _wide_pairs(family, reps, groups, percent)
    pairs = narrow.union(broad).distinct()
    cross = materialize(_similar(pairs, reps, percent).join(tested, ["a", "b"], "left_anti"), "near-cross")
    low = F.col("g") < F.col("h")
    cross = cross.select("a", "b", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    many = materialize(cross.groupBy("g", "h").agg(F.count("*").alias("n")).where(F.col("n") > PAIR_ROWS).select("g", "h"), "near-many")
    few = cross.join(many, ["g", "h"], "left_anti").select("a", "b")
    marked = cross.join(many, ["g", "h"], "left_semi").select("g", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("right"), F.col(c).alias("id")) for i, c in enumerate("xy")])).alias("e"))
    marked = marked.select(F.col("g").alias("k1"), F.col("h").alias("k2"), "e.right", "e.id", F.when(F.col("e.right") == 0, F.col("g")).otherwise(F.col("h")).alias("g")).distinct()
    tasks = _between_sides(marked.unionByName(crowded), reps).union(_in_families(family, reps, groups, BLOCK_SETS))
    dense = _blocks_compared(tasks, texts, width, percent)
    links = star_links.union(_verified(few, texts, width, percent)).union(dense)
    labels = components(links)
    folded = (filled.select("id", "d1", "d2").distinct().join(first, ["d1", "d2"]).groupBy("id").agg(F.min("rep").alias("rep")))
    named = folded.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("component"))
    out = sets.select("id", "n").join(named, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows that repeat its id all stay."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where(~F.col("kept")).select(F.col("id").alias("_gone")).distinct()
    rest = Carried(docs)
    held = docs.select(*rest.cols, F.col(id_col).cast("long").alias("_id"))
    return held.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select(*rest.back())
