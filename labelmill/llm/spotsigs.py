"""Fingerprints of spot signatures: what content words follow common words.

Common words (articles, prepositions) stand in running text but hardly in menus and notices. Each common word that comes right
before a content word is an anchor; with the chain of content words that follows it makes a signature. A document's fingerprint
is the set of its signatures, as sorted hashes. Two documents are as alike as the Jaccard coefficient of their sets.
``similar_documents`` finds all groups of like documents: sets are partitioned by their length and meet only within a partition or
in two that follow each other; rare signatures come first, and lengths and places bound the overlap before a pair is made.

All columns are built-in functions. The anchors are learnt from the corpus: words that make up at least ``1 / ANCHOR_SHARE`` of
all words, so there are never more than ``ANCHOR_SHARE`` of them, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import materialize, whole
from labelmill.llm.graph import components

ANCHOR_SHARE = 1000
CHAIN = 2      # content words of a signature
DISTANCE = 1   # content words from one of them to the next
BUCKET_BYTES = 16 << 20  # text of neighbouring documents that one task sorts
LIST_ROWS = 2000  # a longer list of sets that share a signature is dealt into blocks, which meet two by two


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def anchors_of(docs: DataFrame, text_col: str = "text", share: int = ANCHOR_SHARE) -> list[str]:
    """The words that make up at least one in ``share`` of all words of ``docs``, in word order: at most ``share`` words."""
    each = docs.select(F.explode(words(whole(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = materialize(each, "spot-words")
    total = each.agg(F.sum("n")).first()[0] or 0
    return sorted(r["word"] for r in each.where(F.col("n") * share >= F.lit(total)).select("word").collect())


def signatures(text: Column, anchors: list[str], chain: int = CHAIN, distance: int = DISTANCE) -> Column:
    """The sorted distinct hashes of a text's spot signatures.

    A chain that the text's end cuts is shorter. A text with words but without a signature has one of its whole word sequence;
    one without words has none.
    """
    def chains(content: Column) -> Column:
        follow = lambda x, i: [x["w"], *[F.get(content, i + F.lit(distance * k))["w"] for k in range(1, chain)]]
        return F.transform(content, lambda x, i: F.when(x["before"].isin(anchors), F.xxhash64(x["before"], *follow(x, i))))

    def sets(ws: Column) -> Column:
        marked = F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.get(ws, i - F.lit(1)).alias("before")))
        found = let(F.filter(marked, lambda x: ~x["w"].isin(anchors)), chains)
        alone = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws)))).otherwise(F.array().cast("array<long>"))
        return let(F.sort_array(F.array_distinct(F.array_compact(found))), lambda s: F.when(F.size(s) > 0, s).otherwise(alone))

    return let(words(text), sets)


def likeness(x: Column, y: Column) -> Column:
    """Jaccard coefficient of two sets of signatures; two empty ones are equal (1), an empty and a filled one apart (0)."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def printed(sigs: Column) -> Column:
    """A fingerprint as a string: the sorted signatures, 16 hex digits each."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``value``: a binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def with_next(rows: DataFrame, size: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows (id, h, ...)`` with ``next``: the row that follows by descending ``id`` (null last) and ``h``; the first follows the last.

    Rows are dealt into buckets of neighbouring ids; the first row of each bucket also goes, as a guest, to the bucket before it.
    ``size`` tells a row's bytes, from which the number of buckets follows.
    """
    names = [c for c in rows.columns if c not in ("id", "h")]
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, math.ceil(total / bucket_bytes))
    cuts = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("id", cuts, max(10_000, 10 * parts))).first()[0] if cuts else None
    place = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("id"), sorted(set(bounds or []))))
    dealt = rows.withColumn("bucket", place)
    order = F.struct(F.col("id").isNull(), F.bitwise_not("id"), "h")
    firsts = dealt.groupBy("bucket").agg(F.min(order).alias("first"))
    # One row for each bucket at most; the bucket before holds the next higher ids, that of the highest ids follows the last one.
    firsts = sorted(firsts.collect(), key=lambda r: -r["bucket"])
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    edge = rows.sparkSession.createDataFrame([(r["bucket"], before[r["bucket"]], *r["first"]) for r in firsts],
                                             "bucket int, host int, no_id boolean, id_order long, first_h long")
    is_first = F.col("id").isNull().eqNullSafe(F.col("no_id")) & F.bitwise_not("id").eqNullSafe(F.col("id_order")) & F.col("h").eqNullSafe(F.col("first_h"))
    here = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    sent = (dealt.join(F.broadcast(edge), "bucket").withColumn("to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
            .select("id", "h", *names, "to.bucket", "to.guest"))
    row = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "h")
    return sent.withColumn("next", F.lead(F.struct(*names)).over(row)).where(~F.col("guest")).drop("bucket", "guest", "h")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = ANCHOR_SHARE, chain: int = CHAIN,
                      distance: int = DISTANCE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row; fingerprints as sets.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the first as many of the next row's
    text (all, if that is shorter). Next: by descending id; rows without an id come last, rows that
    repeat an id are documents of their own, in the order of their texts' hashes; after the last row comes the first. A single row
    is its own next. Null texts are empty: no signatures. Equal texts have equal fingerprints. Other columns are not carried. No rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    anchors = anchors_of(texts, share=share)
    sigs = lambda text: signatures(text, anchors, chain, distance)
    rows = texts.select("id", F.xxhash64("text").alias("h"), "text", sigs(F.col("text")).alias("sigs"))
    told = with_next(rows, F.octet_length("text"), bucket_bytes)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = told.select("id", n.cast("long").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    made = made.withColumn("edited_sigs", sigs(F.col("edited")))
    return made.select("id", "n_chars", "edited", F.col("sigs").alias("fingerprint"), F.col("edited_sigs").alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def length_parts(largest: int, percent: int) -> list[int]:
    """The least set size of each partition, up to ``largest``: two sets whose likeness is ``percent`` or more are in one partition or
    in two that follow each other."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def _ordered(sets: DataFrame) -> DataFrame:
    """``sets (k, sigs)`` with ``n`` and ``sigs`` in the order of how many sets hold them, the rarest first."""
    each = sets.select("k", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("f"))
    row = F.struct("f", "sig")
    ordered = each.join(often, "sig").groupBy("k").agg(F.sort_array(F.collect_list(row)).alias("row"))
    return ordered.select("k", F.size("row").alias("n"), F.transform("row", lambda r: r["sig"]).alias("sigs"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are alike enough."""
    one = sets.select(F.col("k").alias("a"), F.col("sigs").alias("x"))
    two = sets.select(F.col("k").alias("b"), F.col("sigs").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(both * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def similar_sets(sets: DataFrame, percent: int = 80, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(k, root)`` for each of the distinct ``sets (k, sigs)`` linked with another: the smallest ``k`` reachable over links.

    Sets are linked if the Jaccard coefficient is ``percent`` or more. Of sets that alike share one of their rarest ``n - ceil(n * percent
    / 100) + 1`` signatures. The sets of a signature and partition first meet the smallest of them; sets linked to the same one need no
    further links among themselves. All others meet each other, in blocks where a list is long, if lengths and the places of the shared signature leave room for enough overlap.
    """
    sets = materialize(_ordered(sets), "spot-sets")
    largest = sets.agg(F.max("n")).first()[0] or 0
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    posted = sets.select("k", "n", _bucket(F.col("n"), length_parts(largest, percent)).alias("part"), F.posexplode(F.slice("sigs", F.lit(1), prefix)).alias("at", "sig"))
    posted = materialize(posted, "spot-posted")
    heads = posted.groupBy("sig", "part").agg(F.min(F.struct("k", "n")).alias("head"))
    near_head = posted.join(heads, ["sig", "part"]).where((F.col("k") != F.col("head.k")) & (F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent))
    stars = materialize(_linked(near_head.select(F.col("head.k").alias("a"), F.col("k").alias("b")).distinct(), sets, percent), "spot-stars")
    settled = stars.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("star"))
    heads_of = posted.join(settled, "k", "left").withColumn("star", F.coalesce("star", "k"))
    # A set also goes to the partition before its own, where the shorter ones are.
    to = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("above")), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("above")))
    sent = heads_of.withColumn("to", F.explode(to)).select("k", "n", "star", "at", "sig", "to.part", "to.above")
    lists = sent.groupBy("sig", "part").agg(F.count("*").alias("rows"), F.max(F.col("above") == 0).alias("own")).where("own AND rows > 1")
    dealt = sent.join(lists.select("sig", "part", F.ceil(F.col("rows") / list_rows).cast("int").alias("blocks")), ["sig", "part"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = dealt.where("above = 0").select("sig", "part", F.col("block").alias("i"), other.alias("j"), *[F.col(c).alias("x_" + c) for c in ("k", "n", "star", "at")])
    y = dealt.select("sig", "part", other.alias("i"), F.col("block").alias("j"), "above", *[F.col(c).alias("y_" + c) for c in ("k", "n", "star", "at")])
    n_x, n_y = F.col("x_n"), F.col("y_n")
    room = 1 + F.least(n_x - F.col("x_at"), n_y - F.col("y_at")) - 1  # the shared signature and what may follow it in both
    fits = ((F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (room * (100 + percent) >= (n_x + n_y) * percent)
            & (F.col("x_star") != F.col("y_star")) & ((F.col("above") == 1) | (F.col("x_k") < F.col("y_k"))))
    met = x.join(y, ["sig", "part", "i", "j"]).where(fits)
    links = _linked(met.select(F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b")).distinct(), sets, percent)
    return components(stars.unionByName(links)).select(F.col("id").alias("k"), F.col("label").alias("root"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, share: int = ANCHOR_SHARE,
                      chain: int = CHAIN, distance: int = DISTANCE, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(id, set_id, group_id)`` for each row: the smallest id with the same fingerprint, and the smallest id reachable over fingerprints
    whose likeness is ``percent`` (of 100) or more.

    Null and empty texts and texts without words have an empty fingerprint and are linked with nothing: both ids are their own. A row
    without an id stays one; it counts as larger than all ids, so a group of such rows alone has null ids. Rows that repeat an id are documents
    of their own. Other columns are not carried, so no name clashes. No rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    sigs = signatures(F.col("text"), anchors_of(texts, share=share), chain, distance)
    rows = texts.select("id", sigs.alias("sigs")).withColumn("k", F.when(F.size("sigs") > 0, F.md5(F.array_join(F.transform("sigs", lambda s: s.cast("string")), ","))))
    rows = materialize(rows, "spot-prints")
    filled = rows.where(F.col("k").isNotNull())
    sets = filled.groupBy("k").agg(F.min("id").alias("set_id"))
    distinct = filled.groupBy("k").agg(F.first("sigs").alias("sigs"))
    roots = materialize(similar_sets(distinct, percent, list_rows), "spot-roots")
    rooted = sets.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    groups = rooted.groupBy("root").agg(F.min("set_id").alias("group_id"))
    named = rooted.join(groups, "root").select("k", "set_id", "group_id")
    alone = rows.where(F.col("k").isNull()).select("id", F.col("id").alias("set_id"), F.col("id").alias("group_id"))
    return filled.select("id", "k").join(named, "k").select("id", "set_id", "group_id").unionByName(alone)
