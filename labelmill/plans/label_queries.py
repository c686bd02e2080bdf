"""Queries on validation and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.functions import text as tx
from labelmill.operators import normalize, validate
from labelmill.storage import new_path
from labelmill.plans.registry import LABELLED_SQL, documents, labelled, query, sql_strip, sql_words, table
from labelmill.sources import readers


def _with_labels(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    return documents(spark, d).join(labels, "row_id", "left")


BLANK = f"{sql_strip('text')} = ''"
USABLE = f"text IS NOT NULL AND NOT ({BLANK}) AND quality IS NOT NULL AND toxic IS NOT NULL"


@query(f"""WITH j AS (SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS total_raw_rows, count(*) FILTER (text IS NULL) AS null_text_samples,
  count(*) FILTER ({BLANK}) AS empty_text_samples, count(*) FILTER (quality IS NULL) AS missing_quality,
  count(*) FILTER (toxic IS NULL) AS missing_toxic, count(*) - count(DISTINCT text) AS duplicate_texts,
  count(DISTINCT text) FILTER ({USABLE}) AS total_clean_rows,
  count(*) - count(DISTINCT text) FILTER ({USABLE}) AS removed_corrupted_or_invalid_rows,
  count(*) - count(DISTINCT doc_id) AS duplicate_ids
FROM j GROUP BY source""")
def validate_profile(spark, d):
    return validate.validation_summary(_with_labels(spark, d), "text", ["quality", "toxic"], id_col="row_id")


@query(f"""SELECT count(*) FILTER (text IS NULL) AS null_text_samples, count(*) FILTER ({BLANK}) AS empty_text_samples,
  count(*) FILTER (quality IS NULL) AS missing_quality, count(*) FILTER (toxic IS NULL) AS missing_toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def null_blank_missing(spark, d):
    """The single checks, side by side."""
    df = _with_labels(spark, d)
    missing = validate.missing_labels(df, ["quality", "toxic"])
    return missing.select(
        validate.null_text_count(df, "text").scalar().alias("null_text_samples"),
        validate.blank_text_count(df, "text").scalar().alias("empty_text_samples"),
        F.col("quality").alias("missing_quality"), F.col("toxic").alias("missing_toxic"))


@query("""SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicate_texts FROM documents""")
def duplicate_texts(spark, d):
    from labelmill.operators.dedup import duplicate_count

    return duplicate_count(table(spark, d, "documents"), tx.fingerprint(F.col("text"))).withColumnRenamed(
        "duplicates", "duplicate_texts")


@query("""SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicate_ids FROM lineitem""")
def duplicate_ids(spark, d):
    from labelmill.operators.dedup import duplicate_count

    return duplicate_count(table(spark, d, "lineitem"), F.col("l_orderkey")).withColumnRenamed("duplicates", "duplicate_ids")


@query(f"""WITH j AS (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT min(doc_id) AS row_id, text FROM j WHERE {USABLE} GROUP BY text""")
def valid_rows(spark, d):
    return validate.valid_rows(_with_labels(spark, d), "text", ["quality", "toxic"]).select("row_id", "text")


def _nested(spark, d):
    """Annotated posts made of documents: two annotators per labelled document, one of whom may have no opinion."""
    severity = lambda bad: F.when(bad, "offensive").otherwise("normal")
    first = F.struct(severity(F.col("quality") == 0).alias("label"))
    second = F.struct(F.when(F.col("toxic") == 1, "hatespeech").when(F.col("quality") == 1, "normal").alias("label"))
    none = F.array().cast("array<struct<label:string>>")
    return _with_labels(spark, d).select(
        F.col("row_id").cast("string").alias("post_id"), tx.words(F.col("text")).alias("post_tokens"),
        F.when(F.col("quality").isNull(), none).otherwise(F.array(first, second)).alias("annotators"))


NESTED_SQL = f"""posts AS (
  SELECT d.doc_id, {sql_words('d.text')} AS tokens, l.quality, l.toxic,
    CASE WHEN len({sql_words('d.text')}) = 0 THEN 'corrupted' WHEN l.quality IS NULL THEN 'corrupted'
         WHEN l.toxic <> 1 AND l.quality <> 1 THEN 'corrupted' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""WITH {NESTED_SQL}
SELECT count(*) AS total_raw_rows, count(*) FILTER (reason = 'corrupted') AS corrupted,
  count(*) FILTER (reason = 'empty') AS empty_text_samples, count(*) - count(DISTINCT doc_id) AS duplicate_ids,
  count(*) FILTER (reason IS NULL) - count(DISTINCT array_to_string(tokens, ' ')) FILTER (reason IS NULL) AS duplicate_texts,
  count(*) FILTER (reason IS NULL) AS total_clean_rows,
  count(*) FILTER (reason IS NOT NULL) AS removed_corrupted_or_invalid_rows FROM posts""")
def nested_validation(spark, d):
    return validate.nested_summary(_nested(spark, d))


@query(f"""WITH {NESTED_SQL}
SELECT array_to_string(tokens, ' ') AS text, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS label,
  'hatexplain' AS source FROM posts WHERE reason IS NULL""")
def annotated_posts(spark, d):
    """Nested records validated and voted on inside the row."""
    good = validate.tag_nested(_nested(spark, d)).filter(F.col("reject_reason").isNull())
    return normalize.normalize_annotated(good)


@query("""WITH j AS (SELECT c_mktsegment AS seg, c_custkey AS id FROM customer)
SELECT id AS post_id, 2::BIGINT AS tokens, seg AS label FROM j""")
def nested_json(spark, d):
    """Records read out of JSON objects keyed by id: one object per customer batch, written and parsed in Spark."""
    posts = table(spark, d, "customer").select(
        F.to_json(F.create_map(
            F.col("c_custkey").cast("string"),
            F.struct(F.array(F.col("c_name"), F.col("c_mktsegment")).alias("post_tokens"),
                     F.array(F.struct(F.col("c_mktsegment").alias("label"))).alias("annotators")))).alias("value"))
    return readers.explode_posts(posts).select(
        F.col("post_id").cast("bigint").alias("post_id"), F.size("post_tokens").cast("bigint").alias("tokens"),
        F.col("annotators")[0]["label"].alias("label"))


@query("SELECT doc_id AS post_id, text, lang AS label FROM documents WHERE text IS NOT NULL")
def keyed_json_files(spark, d):
    """Files of one JSON object each, 1,000 documents in each, written and read again in byte ranges."""
    path = new_path(spark, "keyed-json")
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    post = F.to_json(F.struct(F.array("text").alias("post_tokens"), F.array(F.struct(F.col("lang").alias("label"))).alias("annotators")))
    entry = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('": '), post)
    objects = docs.groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_annotated(spark, path).select(
        F.col("post_id").cast("bigint").alias("post_id"), F.col("post_tokens")[0].alias("text"), F.col("annotators")[0]["label"].alias("label"))


@query("""SELECT o_orderkey, code, CASE code WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS label,
  CASE code WHEN 0 THEN 'Hate Speech' WHEN 1 THEN 'Offensive' WHEN 2 THEN 'Safe' END AS name
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code FROM orders)""")
def code_map(spark, d):
    code = lb.map_code(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2})
    label = lb.map_code(code, lb.CODE_MAP)
    return table(spark, d, "orders").select(
        "o_orderkey", code.alias("code"), label.alias("label"), lb.label_name(label).alias("name"))


@query("""SELECT doc_id, CASE toxic WHEN 0 THEN 0 WHEN 1 THEN 1 END AS label FROM labels""")
def binary_map(spark, d):
    return table(spark, d, "labels").select("doc_id", lb.map_code(F.col("toxic"), lb.BINARY_MAP).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 = 0 THEN 0 ELSE 1 END AS label FROM lineitem""")
def binary_map_nonzero(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", lb.binary_nonzero(F.col("l_linenumber") - 1).alias("label"))


@query("""SELECT o_orderkey, CASE (o_orderkey % 4)::INT WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS label FROM orders""")
def mapping_table(spark, d):
    """Code map by joining the mapping table; code 3 is unknown."""
    mapping = normalize.mapping_table(spark).filter("source = 'davidson'")
    coded = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("code"))
    return normalize.map_with_table(coded, "code", mapping).select("o_orderkey", "label")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber - 1 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Offensive'
  WHEN 2 THEN 'Hate Speech' ELSE 'Class ' || (l_linenumber - 1) END AS name FROM lineitem""")
def label_decode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lb.label_name(F.col("l_linenumber") - 1).alias("name"))


@query(f"WITH {LABELLED_SQL} SELECT row_id, label FROM labelled")
def flag_severity(spark, d):
    return labelled(spark, d).select("row_id", "label")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.5 THEN 2 WHEN l_tax * 10 >= 0.5
  OR l_quantity / 50 >= 0.5 THEN 1 ELSE 0 END AS label FROM lineitem""")
def threshold_severity(spark, d):
    label = lb.score_severity([F.col("l_discount") * 10], [F.col("l_tax") * 10, F.col("l_quantity") / 50])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


VOTE_SQL = """votes AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS v FROM lineitem),
tally AS (SELECT l_orderkey, v, count(*) AS n, min(l_linenumber) AS seen_at FROM votes WHERE v IS NOT NULL GROUP BY ALL)"""
FLAG_MAP = {"N": 0, "A": 1, "R": 2}


def _votes(spark, d):
    return table(spark, d, "lineitem"), lb.map_code(F.col("l_returnflag"), FLAG_MAP)


@query(f"""WITH {VOTE_SQL} SELECT l_orderkey, v AS label, n AS votes FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, v DESC) AS r FROM tally) WHERE r = 1""")
def annotator_vote(spark, d):
    lines, vote = _votes(spark, d)
    return normalize.vote_by_key(lines, "l_orderkey", vote)


@query(f"""WITH {VOTE_SQL} SELECT l_orderkey, v AS label, n AS votes FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen_at, v DESC) AS r FROM tally) WHERE r = 1""")
def vote_first_seen(spark, d):
    lines, vote = _votes(spark, d)
    return normalize.vote_by_key(lines, "l_orderkey", vote, order_by="l_linenumber")
