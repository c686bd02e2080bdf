"""Queries on union, conflicts, deduplication and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.functions import text as tx
from labelmill.operators import merge, neardup, noise, stats
from labelmill.plans.label_queries import FLAG_MAP
from labelmill.plans.registry import LABELLED_SQL, documents, labelled, query, sql_strip, sql_words, table
from labelmill.plans.text_queries import ANY_NOISE, NOISE_SQL
from labelmill.sources import readers
from labelmill.storage import materialize


@query("""SELECT doc_id AS row_id, text, source FROM documents
UNION ALL SELECT (1::BIGINT << 56) + conv_id * 1000 + turn AS row_id, text, role AS source FROM conversations""")
def union_sources(spark, d):
    talk = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", F.col("role").alias("source"))
    return merge.unite([documents(spark, d).select("row_id", "text", "source"), talk])


@query("""SELECT 'benchmark' AS part, item_id AS id, text FROM benchmark UNION ALL SELECT 'documents', doc_id, text FROM documents
UNION ALL SELECT 'pages', page_id, html FROM pages""")
def union_splits(spark, d):
    parts = (("benchmark", "item_id", "text"), ("documents", "doc_id", "text"), ("pages", "page_id", "html"))
    return readers.read_splits([
        table(spark, d, n).select(F.lit(n).alias("part"), F.col(k).alias("id"), F.col(t).alias("text")) for n, k, t in parts])


@query("SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 300")
def bounded_source(spark, d):
    return readers.first_rows(documents(spark, d).select("row_id", "text"), 300)


def _parts(spark, d):
    """Line items as labelled rows: key = part, label = return flag, source = line status."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("canonical_text"), lb.map_code(F.col("l_returnflag"), FLAG_MAP).alias("label"),
        F.col("l_linestatus").alias("source"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"))


def _orders(spark, d):
    """The same per order, where some keys have one label only."""
    return _parts(spark, d).withColumn("canonical_text", F.floor(F.col("row_id") / 100))


ORDERS_SQL = """rows AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS label,
  l_linestatus AS source, l_orderkey * 100 + l_linenumber AS row_id FROM lineitem),
tally AS (SELECT k, label, count(*) AS n FROM rows GROUP BY k, label),
keys AS (SELECT k, count(*) AS labels, max(label) AS worst, max(n) AS top, arg_max(label, n) AS lead FROM tally GROUP BY k),
shared AS (SELECT k, count(*) FILTER (n = top) AS leaders FROM tally JOIN keys USING (k) GROUP BY k),
facts AS (SELECT k, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, list_sort(list(DISTINCT source)) AS source_list,
  min(row_id) AS row_id FROM rows GROUP BY k)"""
MAJORITY = "CASE WHEN leaders > 1 THEN worst ELSE lead END"


@query(f"WITH {ORDERS_SQL} SELECT k AS canonical_text FROM keys WHERE labels > 1")
def conflict_keys(spark, d):
    return merge.conflict_keys(_orders(spark, d), "canonical_text")


@query(f"""WITH {ORDERS_SQL} SELECT r.k AS canonical_text, r.row_id, r.label, r.source, labels > 1 AS conflicting
FROM rows r JOIN keys USING (k)""")
def conflict_partition(spark, d):
    agreed, disputed = merge.split_conflicts(_orders(spark, d), "canonical_text")
    return agreed.withColumn("conflicting", F.lit(False)).unionByName(disputed.withColumn("conflicting", F.lit(True)))


def _resolved(spark, d, strategy):
    out = merge.resolve_and_dedup(_orders(spark, d), strategy)
    # rows of equal id may differ in source, so only values that do not depend on which comes first are shown
    return out.select("row_id", F.col("text").alias("canonical_text"), "label")


@query(f"""WITH {ORDERS_SQL} SELECT row_id, k AS canonical_text, {MAJORITY} AS label
FROM keys JOIN shared USING (k) JOIN facts USING (k)""")
def resolve_majority(spark, d):
    return _resolved(spark, d, "majority_vote")


@query(f"WITH {ORDERS_SQL} SELECT row_id, k AS canonical_text, worst AS label FROM keys JOIN facts USING (k)")
def resolve_severity(spark, d):
    return _resolved(spark, d, "severity_priority")


@query(f"WITH {ORDERS_SQL} SELECT row_id, k AS canonical_text, worst AS label FROM keys JOIN facts USING (k) WHERE labels = 1")
def resolve_remove(spark, d):
    return _resolved(spark, d, "remove")


PARTS_SQL = ORDERS_SQL.replace("l_orderkey AS k", "l_partkey AS k", 1)


@query(f"""WITH {PARTS_SQL}, hist AS (SELECT k, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM tally GROUP BY k)
SELECT k AS text, hist.labels AS original_labels, sources, {MAJORITY} AS resolved_label, 'majority_vote' AS strategy
FROM keys JOIN shared USING (k) JOIN facts USING (k) JOIN hist USING (k) WHERE keys.labels > 1""")
def conflict_audit(spark, d):
    audit = merge.conflict_audit(_parts(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("original_labels")),
                                     lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return audit.withColumns({"original_labels": shown, "sources": F.array_join("sources", "|")})


@query(f"""WITH {PARTS_SQL}, hist AS (SELECT k, string_agg('class ' || label || ': ' || n || ' times', ', ' ORDER BY label) AS l FROM tally GROUP BY k)
SELECT lpad(k::VARCHAR, 8, '0') AS text, l AS label_frequencies, replace(sources, '|', ', ') AS sources,
  'class ' || {MAJORITY} AS resolved_label
FROM keys JOIN shared USING (k) JOIN facts USING (k) JOIN hist USING (k) WHERE labels > 1 ORDER BY 1 LIMIT 20""")
def conflict_report(spark, d):
    rows = _parts(spark, d).withColumn("canonical_text", F.lpad(F.col("canonical_text").cast("string"), 8, "0"))
    return merge.conflict_report(merge.conflict_audit(rows))


@query(f"""WITH {ORDERS_SQL} SELECT r.k AS canonical_text, r.row_id, r.label, r.source FROM rows r JOIN keys USING (k) WHERE labels = 1""")
def drop_conflicts(spark, d):
    return merge.drop_conflicts(_orders(spark, d), "canonical_text")


@query(f"WITH {PARTS_SQL} SELECT k AS canonical_text, sources AS source FROM facts")
def provenance(spark, d):
    parts = _parts(spark, d)
    groups = merge.first_rows(merge.label_groups(parts, "canonical_text"), parts, "canonical_text", {"canonical_text": "canonical_text"})
    return groups.select("canonical_text", F.array_join("sources", "|").alias("source"))


CANON = sql_strip("lower(text)")


@query(f"""SELECT row_id, text, source FROM (SELECT doc_id AS row_id, text, source,
  row_number() OVER (PARTITION BY {CANON} ORDER BY doc_id) AS r
  FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' ELSE text END AS text FROM documents)) WHERE r = 1""")
def canonical_dedup(spark, d):
    """Every third text is in capitals, so that copies differ in case."""
    text = F.when(F.col("row_id") % 3 == 0, F.concat(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "))).otherwise(F.col("text"))
    return merge.canonical_dedup(documents(spark, d).select("row_id", text.alias("text"), "source"))


@query(f"""SELECT row_id, text FROM (SELECT doc_id AS row_id, text,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def raw_dedup(spark, d):
    from labelmill.operators.dedup import keep_first

    return keep_first(documents(spark, d), tx.fingerprint(F.col("text"))).select("row_id", "text")


# ---------------------------------------------------------------- near-duplicates


def _distinct(spark, d):
    """First row of every canonical text: the input of the near-duplicate check."""
    rows = merge.canonical_dedup(documents(spark, d).select("row_id", "text"))
    return rows.withColumn("text", tx.canonical(F.col("text")))


def _sets(spark, d):
    return _distinct(spark, d).select(F.col("row_id").alias("id"), neardup.word_set(F.col("text")).alias("words"))


SETS_SQL = f"""canon AS (SELECT min(doc_id) AS id, {CANON} AS t FROM documents GROUP BY 2),
sets AS MATERIALIZED (SELECT id, list_distinct({sql_words('t')}) AS words FROM canon)"""
PAIRS_SQL = f"""{SETS_SQL},
close AS MATERIALIZED (SELECT a.id AS a, b.id AS b, len(a.words) AS na, len(b.words) AS nb, len(list_intersect(a.words, b.words)) AS s
  FROM sets a JOIN sets b ON a.id < b.id AND least(len(a.words), len(b.words)) >= 0.9 * greatest(len(a.words), len(b.words)) - 1e-9),
pairs AS MATERIALIZED (SELECT a, b, s::DOUBLE / (na + nb - s) AS similarity FROM close WHERE s::DOUBLE / (na + nb - s) >= 0.9)"""
GREEDY_SQL = f"""{PAIRS_SQL},
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)),
earlier AS (SELECT b AS id, list(a) AS before FROM pairs GROUP BY b),
steps AS (SELECT nodes.id, i, coalesce(before, []) AS before FROM nodes LEFT JOIN earlier USING (id)),
greedy AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT s.i, CASE WHEN list_has_any(g.kept, s.before) THEN g.kept ELSE list_append(g.kept, s.id) END
  FROM greedy g JOIN steps s ON s.i = g.i + 1),
kept AS (SELECT unnest(kept) AS id FROM greedy WHERE i = (SELECT max(i) FROM greedy)),
gone AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM kept))"""


@query(f"WITH {SETS_SQL} SELECT word, count(*) AS df FROM (SELECT unnest(words) AS word FROM sets) GROUP BY word")
def doc_freq(spark, d):
    return neardup.document_frequency(_sets(spark, d))


@query(f"""WITH {SETS_SQL}, tokens AS (SELECT id, len(words) AS n, unnest(words) AS word FROM sets),
freq AS (SELECT word, count(*) AS df FROM tokens GROUP BY word),
ranked AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS r FROM tokens JOIN freq USING (word))
SELECT id, n, string_agg(word, ' ' ORDER BY r) AS prefix FROM ranked WHERE r <= n - ceil(0.9 * n - 1e-9) + 1 GROUP BY id, n""")
def rare_prefix(spark, d):
    sets = materialize(_sets(spark, d), "sets")
    return neardup.rare_prefix(sets, 0.9).select("id", F.col("n").cast("bigint").alias("n"), F.array_join("prefix", " ").alias("prefix"))


@query(f"""WITH RECURSIVE {GREEDY_SQL}
SELECT b AS id, min(a) AS kept, round(arg_min(similarity, a), 6) AS similarity FROM pairs JOIN kept ON pairs.a = kept.id
WHERE b NOT IN (SELECT id FROM kept) GROUP BY b""")
def near_dup_removed(spark, d):
    """Every removed row with the kept row it repeats and their Jaccard similarity."""
    return neardup.removed_by(_distinct(spark, d), threshold=0.9).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT id AS row_id FROM canon WHERE id NOT IN (SELECT id FROM gone)")
def near_dup_survivors(spark, d):
    return neardup.drop_near_duplicates(_distinct(spark, d), threshold=0.9).select("row_id")


def _merge_statistics(spark, d):
    rows = labelled(spark, d)
    keyed = noise.remove_noise(rows).withColumn("canonical_text", tx.canonical(F.col("text")))
    resolved = materialize(merge.resolve_and_dedup(keyed), "resolved")
    return merge.merge_statistics(rows, neardup.removed_by(resolved))


MERGE_SQL = (
    f"{LABELLED_SQL}, " + NOISE_SQL.format(src="labelled") +
    f", clean AS (SELECT row_id, {CANON} AS t, label FROM noise WHERE NOT {ANY_NOISE}), " +
    PAIRS_SQL.replace(f"canon AS (SELECT min(doc_id) AS id, {CANON} AS t FROM documents GROUP BY 2)",
                      "canon AS (SELECT min(row_id) AS id, t FROM clean GROUP BY t)") +
    ", " + GREEDY_SQL.split(PAIRS_SQL)[1].lstrip(",\n") +
    f""", stat AS (SELECT (SELECT count(*) FROM labelled) AS total_merged_input,
  (SELECT count(*) FROM noise WHERE too_short) AS too_short, (SELECT count(*) FROM noise WHERE too_few_words) AS too_few_words,
  (SELECT count(*) FROM noise WHERE only_numbers) AS only_numbers, (SELECT count(*) FROM noise WHERE only_symbols) AS only_symbols,
  (SELECT count(*) FROM noise WHERE spam) AS spam, (SELECT count(*) FROM noise WHERE {ANY_NOISE}) AS total_removed,
  (SELECT count(*) - count(DISTINCT t) FROM clean) AS exact_and_canonical_duplicates_removed,
  (SELECT count(*) FROM (SELECT t FROM clean GROUP BY t HAVING count(DISTINCT label) > 1)) AS conflicts_detected,
  (SELECT count(*) FROM gone) AS near_duplicates_removed,
  (SELECT count(DISTINCT t) FROM clean) - (SELECT count(*) FROM gone) AS total_output_rows)""")


@query(f"WITH RECURSIVE {MERGE_SQL} SELECT * FROM stat")
def merge_statistics(spark, d):
    return _merge_statistics(spark, d)


@query(f"""WITH RECURSIVE {MERGE_SQL}
SELECT 0 AS step, 'raw merged' AS stage, total_merged_input AS n FROM stat
UNION ALL SELECT 1, 'after noise', total_merged_input - total_removed FROM stat
UNION ALL SELECT 2, 'after exact dedup', total_merged_input - total_removed - exact_and_canonical_duplicates_removed FROM stat
UNION ALL SELECT 3, 'after near dedup', total_output_rows FROM stat""")
def stage_funnel(spark, d):
    return stats.stage_funnel(_merge_statistics(spark, d))
