"""Queries on balancing, splitting, statistics and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.operators import merge, neardup, noise, qa, sampling, stats
from labelmill.functions import labels as lb
from labelmill.functions import text as tx
from labelmill.plans.registry import LABELLED_SQL, documents, labelled, query, sql_strip, sql_words, table
from labelmill.sources import readers, writers
from labelmill.storage import materialize, new_path

CLASS_NAME = "CASE label WHEN 0 THEN 'Safe' WHEN 1 THEN 'Offensive' WHEN 2 THEN 'Hate Speech' ELSE 'Class ' || label END"

# Orders carry three statuses, which stand for the classes: a table that grows with the scale factor.
ORDERS_SQL = """o AS (SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label,
  o_totalprice, md5('42' || o_orderkey::VARCHAR) AS h FROM orders)"""


def _orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), lb.map_code(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2}).alias("label"),
        "o_totalprice")


@query(f"WITH {LABELLED_SQL} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM labelled GROUP BY label")
def class_distribution(spark, d):
    return sampling.class_distribution(labelled(spark, d))


@query(f"WITH {LABELLED_SQL} SELECT {CLASS_NAME} AS class_name, count(*) AS n FROM labelled GROUP BY 1")
def class_names(spark, d):
    return stats.class_names(labelled(spark, d))


@query(f"""WITH {LABELLED_SQL}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT label, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 4) AS weight FROM c""")
def class_weights(spark, d):
    return sampling.class_weights(labelled(spark, d))


@query(f"""WITH {LABELLED_SQL}, c AS (SELECT k AS label, count(label) AS n, (SELECT count(*) FROM labelled WHERE label <> 1) AS total
  FROM (VALUES (0), (1), (2)) v(k) LEFT JOIN (SELECT * FROM labelled WHERE label <> 1) x ON x.label = k GROUP BY k)
SELECT label, n, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE total::DOUBLE / (3 * n) END, 6) AS weight FROM c""")
def class_weights_fixed(spark, d):
    """With one class left out, which then weighs 1."""
    return sampling.class_weights_fixed(labelled(spark, d).filter("label <> 1")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {ORDERS_SQL} SELECT row_id, label, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r FROM o) WHERE r <= 1000""")
def undersample(spark, d):
    return sampling.undersample(_orders(spark, d), 1000)


@query(f"""WITH {LABELLED_SQL} SELECT row_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || row_id::VARCHAR)) AS r FROM labelled) WHERE r <= 60""")
def presample(spark, d):
    """Three times 20 candidates per class: the largest classes are cut, the smallest is kept whole."""
    return sampling.presample(labelled(spark, d), 20).select("row_id", "label")


@query(f"""WITH {LABELLED_SQL}, ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42' || row_id::VARCHAR)) AS r,
  count(*) OVER (PARTITION BY label) AS size FROM labelled),
draws AS (SELECT DISTINCT label, size, unnest(range(100)) AS draw FROM ranked WHERE size < 100),
picked AS (SELECT label, draw, CAST('0x' || substr(md5('42:' || label || ':' || draw), 1, 8) AS BIGINT) % size + 1 AS r FROM draws)
SELECT row_id, label, 0::BIGINT AS draw FROM ranked WHERE size >= 100 AND r <= 100
UNION ALL SELECT row_id, label, draw FROM ranked JOIN picked USING (label, r)""")
def oversample(spark, d):
    return sampling.oversample(labelled(spark, d).select("row_id", "label"), 100)


RANKED_SQL = f"{ORDERS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r, count(*) OVER (PARTITION BY label) AS n FROM o)"
SPLIT_SQL = f"""{RANKED_SQL}, splits AS (SELECT row_id, label, o_totalprice, CASE WHEN r <= round(n * 0.8) THEN 'train'
  WHEN r <= round(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(f"WITH {SPLIT_SQL} SELECT * FROM splits")
def stratified_split(spark, d):
    return sampling.stratified_split(_orders(spark, d))


@query(f"""WITH {SPLIT_SQL} SELECT split, count(*) AS total, count(*) FILTER (label = 0) AS label_0,
  count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2 FROM splits GROUP BY split""")
def split_meta(spark, d):
    return sampling.split_metadata(sampling.stratified_split(_orders(spark, d)))


DOC_SPLIT_SQL = """ranked AS (SELECT doc_id AS row_id, text, row_number() OVER (ORDER BY md5('42' || doc_id::VARCHAR)) AS r,
  count(*) OVER () AS n FROM documents),
splits AS (SELECT row_id, text, CASE WHEN r <= floor(n * 0.8) THEN 'train'
  WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(f"WITH {DOC_SPLIT_SQL} SELECT row_id, split FROM splits")
def shuffle_split(spark, d):
    return sampling.shuffle_split(documents(spark, d).select("row_id")).select("row_id", "split")


@query(f"""WITH {DOC_SPLIT_SQL}, seen AS (SELECT text, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b,
  bool_or(split = 'test') AS c FROM splits GROUP BY text)
SELECT 'train-validation' AS pair, count(*) FILTER (a AND b) AS overlap FROM seen
UNION ALL SELECT 'train-test', count(*) FILTER (a AND c) FROM seen
UNION ALL SELECT 'validation-test', count(*) FILTER (b AND c) FROM seen""")
def leakage(spark, d):
    """Splitting documents that still hold copies leaks; the counts say how much."""
    return sampling.leakage(sampling.shuffle_split(documents(spark, d).select("row_id", "text")))


@query("SELECT o_orderkey AS row_id FROM orders ORDER BY md5('42' || o_orderkey::VARCHAR) LIMIT 1500")
def random_subset(spark, d):
    return sampling.random_subset(_orders(spark, d), 1500).select("row_id")


@query("SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY md5('42' || o_orderkey::VARCHAR)) AS position FROM orders")
def shuffle_order(spark, d):
    return sampling.with_rank(_orders(spark, d).select("row_id"))


@query(f"WITH {ORDERS_SQL} SELECT row_id, label, o_totalprice FROM o")
def shuffled_rows(spark, d):
    return sampling.shuffled(_orders(spark, d))


# ---------------------------------------------------------------- statistics

N_WORDS = f"len({sql_words('text')})"


@query(f"""SELECT count(*) AS total_samples, round(avg({N_WORDS}), 2) AS average_words, max({N_WORDS})::INT AS max_words,
  round(avg(length(text)), 2) AS average_characters, max(length(text))::INT AS max_characters FROM documents""")
def length_stats(spark, d):
    return stats.length_stats(documents(spark, d))


@query(f"""WITH w AS (SELECT source, unnest({sql_words('text')}) AS w FROM documents)
SELECT source, count(DISTINCT w) AS exact, TRUE AS within_bound FROM w GROUP BY source
UNION ALL SELECT '(all)', count(DISTINCT w), TRUE FROM w""")
def vocab_sketches(spark, d):
    """Sketches for each source, united for the whole, next to the exact counts."""
    docs = documents(spark, d)
    sketches = materialize(stats.vocabulary_sketches(docs, ["source"]), "vocabulary-sketches")
    near = stats.vocabulary_estimates(sketches, ["source"]).unionByName(stats.vocabulary_estimates(sketches).withColumn("source", F.lit("(all)")))
    words = docs.select("source", F.explode(tx.words(F.col("text"))).alias("word")).dropDuplicates()
    exact = words.groupBy("source").agg(F.count("*").alias("exact")).unionByName(
        words.agg(F.count_distinct("word").alias("exact")).withColumn("source", F.lit("(all)")))
    same = exact["source"].eqNullSafe(near["source"])
    return exact.join(near, same).select(exact["source"], "exact", (F.abs(F.col("vocabulary_size") - F.col("exact")) <= 0.025 * F.col("exact")).alias("within_bound"))


@query(f"SELECT count(DISTINCT w) AS vocabulary_size FROM (SELECT unnest({sql_words('text')}) AS w FROM documents)")
def vocab_size(spark, d):
    return stats.vocabulary_size(documents(spark, d))


@query(f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM documents)
GROUP BY w ORDER BY n DESC, w LIMIT 20""")
def top_words(spark, d):
    return stats.top_words(documents(spark, d))


@query(f"""WITH c AS (SELECT {N_WORDS} AS size FROM documents), r AS (SELECT size, min(size) OVER () AS lo, max(size) OVER () AS hi FROM c)
SELECT least(((size - lo) * 40) // (hi - lo), 39)::INT AS bin,
  round(min(lo + least(((size - lo) * 40) // (hi - lo), 39) * (hi - lo) / 40.0::DOUBLE), 4) AS bin_start, count(*) AS n FROM r GROUP BY 1""")
def length_hist(spark, d):
    return stats.word_count_histogram(documents(spark, d))


@query()
def statistics_document(spark, d):
    rows = labelled(spark, d)
    keyed = noise.remove_noise(rows).withColumn("canonical_text", tx.canonical(F.col("text")))
    resolved = materialize(merge.resolve_and_dedup(keyed), "resolved")
    near = neardup.removed_by(resolved)
    merged = resolved.join(near.select(F.col("id").alias("row_id")), "row_id", "left_anti")
    splits = sampling.stratified_split(sampling.undersample(merged, 5000))
    return stats.statistics_document(merged, merge.merge_statistics(rows, near), sampling.split_metadata(splits))


# ---------------------------------------------------------------- written files

@query(f"""SELECT doc_id AS row_id, md5(text) AS digest, lang, source FROM documents""")
def csv_round_trip(spark, d):
    """Documents written as CSV and read back by the reader that finds each file's encoding."""
    path = new_path(spark, "csv")
    writers.write_csv(documents(spark, d).select("row_id", "text", "lang", "source"), path)
    schema = "row_id long, text string, lang string, source string"
    back = readers.read_csv(spark, path, StructType.fromDDL(schema))
    return back.select("row_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "lang", "source")


@query("""SELECT source AS split, 0::BIGINT AS violations, true AS passed FROM documents GROUP BY source""")
def written_files(spark, d):
    """The bytes of written CSV files, one folder for each source, are valid UTF-8."""
    path = new_path(spark, "splits-csv")
    writers.write_splits_csv(documents(spark, d).select("row_id", "text", F.col("source").alias("split")), path)
    checks = qa.file_checks(spark, path)
    split = F.regexp_extract("subject", "/split=([^/]+)/", 1)
    return checks.groupBy(split.alias("split")).agg(F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed"))


# ---------------------------------------------------------------- quality gate

QA_SQL = f"""{LABELLED_SQL}, canon AS (SELECT {sql_strip('lower(text)')} AS text, row_id, label, label + (row_id % 50 = 0)::INT AS noisy FROM labelled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || row_id::VARCHAR)) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM canon),
splits AS (SELECT text, noisy AS label, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM ranked),
seen AS (SELECT text, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM splits GROUP BY text),
checks AS (SELECT 'null_text' AS "check", split AS subject, count(*) FILTER (text IS NULL) AS violations FROM splits GROUP BY split
UNION ALL SELECT 'blank_text', split, count(*) FILTER ({sql_strip('text')} = '') FROM splits GROUP BY split
UNION ALL SELECT 'invalid_utf8', split, 0 FROM splits GROUP BY split
UNION ALL SELECT 'invalid_label', split, count(*) FILTER (label NOT IN (0, 1, 2)) FROM splits GROUP BY split
UNION ALL SELECT 'overlap', 'train-validation', count(*) FILTER (a AND b) FROM seen
UNION ALL SELECT 'overlap', 'train-test', count(*) FILTER (a AND c) FROM seen
UNION ALL SELECT 'overlap', 'validation-test', count(*) FILTER (b AND c) FROM seen)"""


def _splits_with_faults(spark, d):
    """Splits of labelled documents, copies included, where every fiftieth label is raised by one."""
    rows = labelled(spark, d).withColumn("text", tx.canonical(F.col("text")))
    splits = sampling.stratified_split(rows)
    return splits.withColumn("label", F.col("label") + (F.col("row_id") % 50 == 0).cast("int"))


@query(f'WITH {QA_SQL} SELECT "check", subject, violations, violations = 0 AS passed FROM checks')
def qa_gate(spark, d):
    return qa.quality_checks(_splits_with_faults(spark, d))


@query(f"WITH {QA_SQL} SELECT label, count(*) AS n FROM splits WHERE label NOT IN (0, 1, 2) GROUP BY label")
def invalid_labels(spark, d):
    return qa.invalid_labels(_splits_with_faults(spark, d))


@query("""SELECT p_size AS label, count(*) AS n FROM part WHERE p_size NOT IN (0, 1, 2) OR p_size IS NULL GROUP BY p_size""")
def rejected_rows(spark, d):
    """Rows that balancing would leave out, by label: part sizes as labels, three of them valid."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("label"))
    return sampling.rejected_labels(parts).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN p_size IN (0, 1, 2) THEN 'train' END AS split, count(*) AS n FROM part WHERE p_size IN (0, 1, 2) GROUP BY 1
UNION ALL SELECT 'rejected', count(*) FROM part WHERE p_size NOT IN (0, 1, 2) OR p_size IS NULL""")
def flow_accounts_for_all(spark, d):
    """Rows split and rows rejected add up to the table."""
    from labelmill.config import Split

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("label"))
    good = sampling.stratified_split(parts, Split(shares=(1, 0, 0))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    bad = sampling.rejected_labels(parts).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("split"), "n")
    return good.unionByName(bad)
