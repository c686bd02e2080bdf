"""Near-duplicate removal: exact word-set Jaccard with a greedy keep-first rule.

Rows are taken in id order; a row goes when an earlier *kept* row has word-set similarity of at
least ``threshold``. Candidates come from an equi-join on parts of the sets (:func:`part_entries`), so no pair is missed and
nothing is estimated. A part holds about ``(1+t)/(2(1-t))`` words, all of which must agree, so that the groups hardly grow with the
corpus; each row makes its parts from its own words alone. Three measures keep the work linear in the presence of hot groups:

* rows with equal word sets fold to their first row before any pairing;
* in large groups, rows with the same smallest word hash are likely copies: the first row of
  each such family (a leader) is compared with all members of its groups, which settles clusters of near copies;
* large groups of what is left are dealt into blocks and joined block against block. The join condition
  holds the sizes and a bitmap bound, so that hardly a dissimilar pair becomes a row.

Words are told apart by 64-bit hashes. A set's bitmap has one bit for each of 128 hash classes: whether an odd number of its words
falls into it. Two sets differ in at least as many words as their bitmaps do in bits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.operators.dedup import keep_first
from labelmill.storage import materialize

EPS = 1e-9
SALT, PARTNERS = 16, 1000  # copies of a word set at most; partners that are worth one more
SLICE = 500_000            # words whose parts are made at once
BROADCAST_ROWS = 1_000_000
COMMON_WORDS = 4096
LEADER_ROUNDS = 3
FAMILY = 8           # rows of a large group with one smallest hash that are worth a leader
BLOCK = 256          # members of a large group in a block
SETTLE_PAIRS = 500_000  # pairs, of two longs and a double, that one task may settle
BITMAP = ("m0", "m1")


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tx.words(text)))


def min_overlap(n: Column, threshold: float) -> Column:
    """Fewest words a set of ``n`` words must share with a similar one: ``ceil(t * n)``, safe against rounding."""
    return F.ceil(n * F.lit(float(threshold)) - EPS).cast("int")


def prefix_length(n: Column, threshold: float) -> Column:
    """Two similar sets share a word among the first ``n - ceil(t * n) + 1`` of each."""
    return n - min_overlap(n, threshold) + 1


def document_frequency(sets: DataFrame) -> DataFrame:
    """``(word, df)``: the number of rows whose set holds the word."""
    return sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def _with_frequency(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """Inner join of tokens with word frequencies that no very common word can overload.

    The most common words (a fixed number, of bounded length) are broadcast; only the tokens left
    over, none of them frequent, are shuffled by word.
    """
    common = (
        freq.filter(F.length("word") <= 64).orderBy(F.desc("df"), "word").limit(COMMON_WORDS)
        .withColumnRenamed("df", "common_df")
    )
    tagged = tokens.join(F.broadcast(common), "word", "left")
    rare = tagged.filter(F.col("common_df").isNull()).drop("common_df").join(freq, "word")
    return tagged.filter(F.col("common_df").isNotNull()).withColumnRenamed("common_df", "df").unionByName(rare)


def rare_prefix(sets: DataFrame, threshold: float, extra: int = 0, min_df: int = 1) -> DataFrame:
    """``(id, n, skipped, prefix)``: the first words of each set in ``(df, word)`` order.

    With ``min_df=2`` words that no other row has are left out and only counted (``skipped``): they come
    first in the order but can match nothing.
    """
    freq = materialize(document_frequency(sets).filter(F.col("df") >= min_df), "frequency")
    tokens = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    ranked = (
        _with_frequency(tokens, freq)
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    )
    skipped = F.col("n") - F.size("ranked")
    length = F.greatest(prefix_length(F.col("n"), threshold) + extra - skipped, F.lit(0))
    return ranked.select(
        "id", "n", skipped.alias("skipped"),
        F.transform(F.slice("ranked", 1, length), lambda r: r["word"]).alias("prefix"),
    )


def size_classes(largest: int, threshold: float) -> np.ndarray:
    """Upper ends of classes of set sizes, from 1 to the one after ``largest``; similar sets fall into one class or into neighbouring ones."""
    ends = [math.floor(1 / threshold + EPS)]
    while len(ends) < 2 or ends[-2] < largest:
        ends.append(math.floor((ends[-1] + 1) / threshold + EPS))
    return np.array(ends, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _keys(words: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` for all parts of the sets of sizes ``n`` that lie one behind the other in ``words``."""
    ends = size_classes(int(n.max(initial=1)), threshold)
    own = np.searchsorted(ends, n)
    apart = 2 * (1 - threshold) / (1 + threshold)
    hashes = _mixed(words.view(np.uint64))
    rows, keys = [], []
    for step in (0, 1):
        parts = np.floor(ends[own + step] * apart + EPS).astype(np.int64) + 1
        start = np.concatenate([[0], np.cumsum(parts)])
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(start[-1]) - start[row]
        of = np.repeat(np.arange(len(n)), n)
        place = start[of] + ((hashes >> np.uint64(32)) % parts[of].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(start[-1], np.uint64)
        np.add.at(sums, place, hashes)
        salt = _mixed((part.astype(np.uint64) << np.uint64(32)) + (own[row] + step).astype(np.uint64) + np.uint64(1))
        rows.append(row)
        keys.append(_mixed(sums + salt))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _in_parts(threshold: float):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("words")
            n, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            place = np.concatenate([[0], np.cumsum(n)])
            cuts = np.unique(np.concatenate([[0], np.searchsorted(place[1:], np.arange(SLICE, place[-1], SLICE)) + 1, [len(n)]]))
            for x, y in zip(cuts[:-1], cuts[1:]):
                row, key = _keys(flat[place[x]:place[y]], n[x:y], threshold)
                yield pa.record_batch([pa.array(key), pa.array(ids[x:y][row]), pa.array(n[x:y][row].astype(np.int32))], schema=schema)

    return run


def part_entries(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, id, n)``: one row for each part of each set. Similar sets have equal words in some part and so share a key.

    Similar sets of at most ``u`` words differ in at most ``2u(1-t)/(1+t)`` words. Dealt by a hash into one part more than that,
    all words of both fall so that some part holds none of those. ``u`` is the end of a size class; each set is dealt for its own class and the next.
    """
    return sets.select("id", "words").mapInArrow(_in_parts(threshold), "key long, id long, n int")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries whose key others have as well, with the number of ``members``."""
    held = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return entries.drop("members").join(held, "key")


def _hinted(df: DataFrame) -> DataFrame:
    """A small table is sent to all tasks."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bitmap(hashes: Column) -> list[Column]:
    """Two longs: the parity of the number of hashes in each of 128 classes."""
    def part(k: int) -> Column:
        mine = F.filter(hashes, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(1)) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(_bit(h)))

    return [part(k).alias(m) for k, m in enumerate(BITMAP)]


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _dealt(entries: DataFrame, group_limit: int) -> DataFrame:
    """Entries with ``task``: one for each group; in a large group one for each pair of its blocks that holds the entry."""
    marked = entries.withColumn("blocks", F.when(F.col("members") > group_limit, F.ceil(F.col("members") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64(F.lit(3), "id"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(block, i).alias("x"), F.greatest(block, i).alias("y")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    return (marked.withColumn("task", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))
            .withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(block)).drop("blocks", "members"))


def _similar(left: DataFrame, right: DataFrame, sets: DataFrame, threshold: float, on: Column) -> DataFrame:
    """Verified pairs ``(a, b, similarity)``, ``a < b``, among the rows of ``left AS x`` and ``right AS y`` that meet ``on``."""
    t = F.lit(float(threshold))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    total = F.col("x.n") + F.col("y.n")
    needed = F.ceil(total * t / (t + 1) - EPS)
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in BITMAP])
    candidates = (
        left.alias("x").join(right.alias("y"), on & (small >= large * t - EPS) & (apart <= total - 2 * needed))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    candidates = materialize(candidates, "candidates")
    # a row may meet many partners: then its word set is copied and the pairs are salted
    copies = candidates.groupBy("a").agg(F.least(F.ceil(F.count(F.lit(1)) / PARTNERS), F.lit(SALT)).cast("int").alias("copies"))
    some = sets.select("id", "words").join(_hinted(materialize(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met")), "id")
    some = materialize(some, "met_sets")
    salted = candidates.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
    leaders = some.join(copies.withColumnRenamed("a", "id"), "id").select(
        F.col("id").alias("a"), F.col("words").alias("words_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    members = some.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    similarity = shared / (F.size("words_a") + F.size("words_b") - shared)
    return (
        salted.join(leaders, ["a", "salt"]).join(members, "b")
        .select("a", "b", similarity.alias("similarity"))
        .filter(F.col("similarity") >= t)
    )


def _leaders(entries: DataFrame, sets: DataFrame, group_limit: int) -> DataFrame:
    """The first row of each large group, and of each family in it: ``(id)``."""
    least = sets.select("id", F.get("words", F.lit(0)).alias("least"))  # word hashes are sorted
    large = entries.filter(F.col("members") > group_limit).select("key", "id")
    families = large.join(least, "id").groupBy("key", "least").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    first = large.groupBy("key").agg(F.min("id").alias("id"))
    return families.filter(F.col("n") >= FAMILY).select("id").unionByName(first.select("id")).distinct()


def _settle(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Apply the keep-first rule to verified pairs.

    A row without an undecided earlier partner stays (if all its partners are ``known``) and removes
    its later partners; repeated until nothing changes. Returns ``(removed, pairs left open)``.
    """
    removed, open_pairs = [], pairs
    while True:
        first = open_pairs.select(F.col("a").alias("id")).distinct().join(
            open_pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti"
        )
        if known is not None:
            first = first.join(known, "id", "left_semi")
        gone = materialize(
            open_pairs.join(first.withColumnRenamed("id", "a"), "a")
            .groupBy("b").agg(F.min("a").alias("kept"), F.min_by("similarity", "a").alias("similarity"))
            .withColumnRenamed("b", "id"),
            "removed",
        )
        if gone.isEmpty():
            break
        removed.append(gone)
        ids = gone.select("id")
        open_pairs = materialize(
            open_pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_anti")
            .join(ids.withColumnRenamed("id", "b"), "b", "left_anti"),
            "open",
        )
        if open_pairs.isEmpty():
            break
    empty = open_pairs.limit(0).select(F.col("b").alias("id"), F.col("a").alias("kept"), "similarity")
    return reduce(DataFrame.unionByName, removed, empty), open_pairs


def _settle_clusters(entries: DataFrame, sets: DataFrame, threshold: float, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows removed by kept leaders, and the ids that are settled by it.

    A leader that an earlier row comes before waits for that row, which leads in the next round. Rounds only save work.
    """
    new = materialize(_leaders(entries, sets, group_limit), "leaders")
    leaders = pairs = None
    for turn in range(LEADER_ROUNDS):
        heads = entries.join(new, "id", "left_semi")
        # a leader meets all rows of its groups, so all its partners are known
        met = materialize(_similar(heads, entries, sets, threshold, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id"))), "pairs")
        leaders = new if leaders is None else materialize(leaders.unionByName(new), "leaders")
        pairs = met if pairs is None else materialize(pairs.unionByName(met).dropDuplicates(["a", "b"]), "pairs")
        gone, open_pairs = _settle(pairs, leaders)
        waiting = open_pairs.join(leaders.withColumnRenamed("id", "b"), "b").groupBy("b").agg(F.min("a").alias("id"))
        new = materialize(waiting.select("id").distinct().join(leaders, "id", "left_anti"), "leaders")
        if turn == LEADER_ROUNDS - 1 or new.isEmpty():
            break
    # leaders with no open earlier partner are kept and have met all their later partners
    open_rows = open_pairs.select(F.col("b").alias("id")).distinct()
    return gone, materialize(leaders.join(open_rows, "id", "left_anti").unionByName(gone.select("id")), "settled")


GONE = "id long, kept long, similarity double"


def _greedy(table: pa.Table) -> pa.Table:
    """The keep-first rule over all pairs of some components."""
    a, b, similarity = (table.column(c).to_numpy() for c in ("a", "b", "similarity"))
    order = np.lexsort((a, b))  # when a row's turn comes all earlier ones are decided
    removed, out = set(), []
    for i in order:
        x, y = int(a[i]), int(b[i])
        if y not in removed and x not in removed:
            removed.add(y)
            out.append((y, x, float(similarity[i])))
    ids, kept, how = zip(*out) if out else ((), (), ())
    return pa.table({"id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.int64()), "similarity": pa.array(how, pa.float64())})


def _component_labels(pairs: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id reachable; labels of labels make the rounds grow with the logarithm of a chain's length."""
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))
    while True:
        labels = materialize(labels, "labels")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = lower.join(far, "label").select("id", "old", F.least("label", "far").alias("label"))
        if new.filter("label < old").isEmpty():
            return labels
        labels = new.select("id", "label")


def settle(pairs: DataFrame, most: int = SETTLE_PAIRS) -> DataFrame:
    """Rows that the keep-first rule removes, ``(id, kept, similarity)``, given all similar pairs ``(a, b, similarity)`` with ``a < b``.

    ``kept`` is the first kept row that is similar. Components of at most ``most`` pairs are dealt into tasks of about as many and settled there;
    larger ones in rounds. No pairs: no rows.
    """
    total = pairs.count()
    if total <= most:
        return pairs.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_greedy, GONE)
    labelled = pairs.join(_component_labels(pairs).withColumnRenamed("id", "a"), "a")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(sizes.filter(F.col("size") > most).select("label"), "large")  # fewer than total / most
    parts = F.pmod(F.xxhash64("label"), F.lit(-(-total // most))).cast("int").alias("part")
    done = labelled.join(F.broadcast(large), "label", "left_anti").select("a", "b", "similarity", parts).groupBy("part").applyInArrow(_greedy, GONE)
    rest = materialize(labelled.join(F.broadcast(large), "label", "left_semi").select("a", "b", "similarity"), "rest")
    return done if rest.isEmpty() else done.unionByName(_settle(rest, None)[0])


def removed_by(df: DataFrame, text: str = "text", id_col: str = "row_id", threshold: float = 0.9,
               group_limit: int = 64) -> DataFrame:
    """Rows to drop: ``(id, kept, similarity)``, each with a kept row that it repeats.

    Runs jobs: the number of rounds depends on the data. Intermediate tables go to the shared folder.
    """
    words = word_set(F.col(text))
    hashed = df.select(F.col(id_col).alias("id"), words.alias("text_words")).filter(F.size("text_words") > 0).select(
        "id", F.array_sort(F.array_distinct(F.transform("text_words", lambda w: F.xxhash64(w)))).alias("words"),
        tx.fingerprint(F.array_join("text_words", " ")).alias("digest"))
    sets_all = materialize(hashed.select("id", "words", "digest"), "sets")
    named = sets_all.select("id", "digest")
    first = materialize(keep_first(named, F.col("digest"), "id"), "first")
    known = first.select(F.col("id").alias("first"), F.col("digest").alias("known"))
    alike = F.col("id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("known"))
    copied = _hinted(materialize(named.join(known, alike, "left_anti").distinct(), "copied").withColumnsRenamed({"id": "first", "digest": "known"}))
    sets = sets_all.join(copied, alike, "left_anti").filter("id IS NOT NULL").select("id", "words")
    entries = materialize(_shared(part_entries(sets, threshold)), "entries")
    met = _hinted(materialize(entries.select("id").distinct(), "met"))
    bits = materialize(sets.join(met, "id").select("id", *bitmap(F.col("words"))), "bits")
    entries = materialize(entries.join(bits, "id"), "entries")

    removed = []
    if not entries.filter(F.col("members") > group_limit).isEmpty():
        gone, settled = _settle_clusters(entries, sets, threshold, group_limit)
        removed.append(gone)
        entries = materialize(_shared(entries.join(settled, "id", "left_anti")), "entries")
    dealt = _dealt(entries, group_limit)
    one, two = dealt.filter(F.col("block") == F.col("task.x")), dealt.filter(F.col("block") == F.col("task.y"))
    # of two blocks the one row is on the left, the other on the right; within a block the earlier row is on the left
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.task") == F.col("y.task")) & ((F.col("x.block") < F.col("y.block")) | (F.col("x.id") < F.col("y.id")))
    removed.append(settle(materialize(_similar(one, two, sets, threshold, meet), "pairs")))
    dropped = materialize(reduce(DataFrame.unionByName, removed), "dropped")

    # later rows with the very same word set share the fate of the first one or repeat it
    copies = (
        named.join(first.select("id"), "id", "left_anti")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    )
    fate = (
        first.select(F.col("id").alias("first"), "digest")
        .join(named.select("digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "digest")
        .join(dropped.withColumnRenamed("id", "first"), "first", "left")
        .select(
            "digest", F.coalesce("kept", "first").alias("kept"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
            F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"),
        )
    )
    repeated = copies.join(fate, ["digest", "salt"]).select("id", "kept", "similarity")
    return dropped.unionByName(repeated)


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "row_id", threshold: float = 0.9,
                         group_limit: int = 64) -> DataFrame:
    """Rows that survive the greedy rule."""
    gone = removed_by(df, text, id_col, threshold, group_limit).select(F.col("id").alias(id_col))
    return df.join(gone, id_col, "left_anti")
