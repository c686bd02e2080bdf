"""Documents that hold passages of a benchmark, by winnowing.

Of every ``span - k + 1`` neighbouring k-gram hashes the smallest is kept as a fingerprint. Two texts that share ``span``
words share all hashes of that window and so its smallest one: no shared span is missed. Documents whose fingerprints meet a
benchmark fingerprint are read once more; each hit is extended to the windows around it, and these are compared as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import ascii_lower, materialize, small, whole, Carried

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
BROADCAST_ROWS = 1_000_000  # of (hash) or (id, hashes) rows; more are joined by shuffle


def words_of(text: Column) -> Column:
    return _split(ascii_lower(text), BREAK)


def _split(text: Column, breaks: str) -> Column:
    return F.filter(F.split(text, breaks, -1), lambda w: w != "")


def kgrams(words: Column, k: int) -> Column:
    """Hashes of all k-grams, in order; ``words`` must be a plain column."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(F.slice(words, i + 1, k))), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def winnow(hashes: Column, window: int) -> Column:
    """The distinct minima of all windows; ``hashes`` must be a plain column."""
    n = F.size(hashes) - (window - 1)
    mins = F.transform(F.slice(hashes, F.lit(1), F.greatest(n, F.lit(0))), lambda h, i: F.array_min(F.slice(hashes, i + 1, window)))
    return F.array_distinct(mins)


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Distinct ``(item, words)``: all windows of ``span`` words; an item of fewer words is one window."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(whole(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (span - 1), F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), span).alias("words"))
    return cut.distinct()


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", span: int = 13, k: int = 5, least_share: float = 0.05) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted item ids as strings) and ``contaminated``.

    A document word is hit when it lies inside an occurrence of ``span`` consecutive item words, or of a whole item of fewer
    words. ``contaminated``: some word is hit and hit words make up ``least_share`` or more. Null text has no words; a
    null document id is kept and judged like any other; a null item id is listed as ``null``. Empty benchmark: nothing is
    hit. Rows that repeat an id are judged by their own texts. Columns with the names of the results are replaced.
    """
    windows = materialize(benchmark_windows(items, item_col, item_text_col, span), "bench-windows")
    lengths = sorted(r[0] for r in windows.select(F.size("words").alias("n")).distinct().collect())  # span values at most
    rest = Carried(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    key = [F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_version")]
    hits = None
    for n in lengths:
        size = min(k, n)
        bench = (windows.where(F.size("words") == n).select(kgrams(F.col("words"), size).alias("g"))
                 .select(F.explode(winnow(F.col("g"), n - size + 1)).alias("_h")).distinct())
        prints = (docs.select(*key, words_of(whole(text_col)).alias("_w")).select("_id", "_version", kgrams(F.col("_w"), size).alias("_g"))
                  .select("_id", "_version", F.explode(winnow(F.col("_g"), n - size + 1)).alias("_h")))
        met = prints.join(_hinted(materialize(bench, "bench-prints")), "_h").groupBy("_id", "_version").agg(F.collect_set("_h").alias("_met"))
        found = _extend(docs, materialize(met, "bench-met"), windows.where(F.size("words") == n), key, id_col, text_col, n, size)
        hits = found if hits is None else hits.unionByName(found)
    base = docs.select(*rest.cols, F.col(id_col).alias("_own"), F.xxhash64(whole(text_col)).alias("_version"),
                       F.size(_split(whole(text_col), BREAK_ANY_CASE)).cast("long").alias("n_words"))
    if hits is None:
        judged = base.select(*rest.back(), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        hits = materialize(hits, "bench-hits")
        cover = (hits.select("_id", "_version", "_at", "_n").distinct()
                 .groupBy("_id", "_version").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1))))).cast("long").alias("n_hit")))
        named = hits.select("_id", "_version", "item").distinct().groupBy("_id", "_version").agg(F.array_sort(F.collect_list("item")).alias("items"))
        both = cover.alias("c").join(named.alias("i"), F.col("c._id").eqNullSafe(F.col("i._id")) & (F.col("c._version") == F.col("i._version"))).select(
            F.col("c._id").alias("_id"), F.col("c._version").alias("_hit_version"), "n_hit", "items")
        joined = base.join(both, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_hit_version")), "left")
        judged = joined.select(*rest.back(), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                               F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    share = F.lit(round(1 / least_share)) * F.col("n_hit") >= F.col("n_words")
    return judged.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & share)


def _extend(docs: DataFrame, met: DataFrame, windows: DataFrame, key: list[Column], id_col: str, text_col: str, n: int, k: int) -> DataFrame:
    """Windows of ``n`` words around met fingerprints that equal a benchmark window: ``(_id, _version, _at, _n, item)``."""
    side = _hinted(met.select(F.col("_id").alias("_mid"), F.col("_version").alias("_mversion"), "_met"))
    texts = docs.select(*key, whole(text_col).alias("_text"))
    again = (texts.join(side, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_version") == F.col("_mversion")))
             .select("_id", "_version", "_met", words_of(F.col("_text")).alias("_w"))
             .select("_id", "_version", "_met", "_w", kgrams(F.col("_w"), k).alias("_g")))
    marks = F.filter(F.transform("_g", lambda h, i: F.when(F.array_contains("_met", h), i)), lambda i: i.isNotNull())
    last = F.size("_w") - n
    around = F.array_distinct(F.flatten(F.transform(F.col("_marks"), lambda p: F.when(
        F.least(p, last) >= F.greatest(p - (n - k), F.lit(0)), F.sequence(F.greatest(p - (n - k), F.lit(0)), F.least(p, last))).otherwise(F.array().cast("array<int>")))))
    at = again.select("_id", "_version", "_w", marks.alias("_marks")).select("_id", "_version", "_w", F.explode(around).alias("_at"))
    return (at.select("_id", "_version", "_at", F.slice("_w", F.col("_at") + 1, n).alias("words"))
            .join(_hinted(windows), "words").select("_id", "_version", "_at", F.lit(n).alias("_n"), "item"))
