"""Lines that many documents share (menus, notices, licences) stay in one document only.

Lines are exploded as ``(document, position, hash of the normalised line)`` without their text; a hash is repeated when
documents with different ids hold it (minimum and maximum id differ, combined on the map side, so that a line held by a
third of all documents costs one row for each task). Only positions to drop are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import ascii_lower, materialize, whole, Carried

STRIPPED = " \t\n\x0b\f\r"


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line of ``min_chars`` code points or more: id, text version, position, 128-bit hash of its key."""
    keys = F.transform(F.split(ascii_lower(whole(text_col)), "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)))
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_version"), F.posexplode(keys).alias("_pos", "_key"))
    return lines.where(F.col("_id").isNotNull() & (F.char_length("_key") >= min_chars)).select(
        "_id", "_version", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64("_key", F.lit("second")).alias("_h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                        min_docs: int = 2) -> DataFrame:
    """``docs`` with shared lines removed from ``text_col``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least ``min_chars`` code points
    that at least ``min_docs`` different documents hold lose all their lines, except those in the smallest id that holds
    the key. Null text: one empty line. Null ids: passed through unchanged and not counted as holders. Rows that repeat an
    id count as one document. All lines dropped: empty text. No rows: no rows. Columns named ``n_lines`` or ``n_dropped``
    are replaced; all others come back as they are, before the text.
    """
    lines = materialize(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    if min_docs <= 2:
        holders = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    else:
        once = lines.groupBy("_h1", "_h2", "_id").count()
        holders = once.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    drops = (lines.join(holders.select("_h1", "_h2", "_first"), ["_h1", "_h2"]).where("_id > _first")
             .groupBy("_id", "_version").agg(F.collect_set("_pos").alias("_drop")))
    drops = drops.select(F.col("_id").alias("_drop_id"), F.col("_version").alias("_drop_version"), "_drop")
    rest = Carried(docs, "n_lines", "n_dropped", text_col)
    split = docs.select(*rest.cols, F.col(id_col).alias("_id"), F.split(whole(text_col), "\n", -1).alias("_lines"), F.xxhash64(whole(text_col)).alias("_version"))
    joined = split.join(drops, (F.col("_id") == F.col("_drop_id")) & (F.col("_version") == F.col("_drop_version")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("_lines")[i]), "\n"))
    return joined.select(*rest.back(), text.alias(text_col), F.size("_lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
