"""The registered queries of this subpackage: thin digests of the operators' results, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import decontam, html_text, language_model, line_dedup, mixing, near_dedup, pii, quality, substring_dedup, url_filter
from labelmill.llm.common import docs_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op6_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.first IS NOT NULL AND k.doc_id > h.first AS dropped
  FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(docs_table(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    of_kind = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


@query("op9_decontamination", r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, spots.n, s, item_id FROM spots JOIN win ON win.n = spots.n AND win.words = spots.words),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir).select("doc_id", "text")
    found = decontam.find_contamination(docs, docs_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_near_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
sets AS (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.v = y.v AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS root, a AS node FROM ways UNION SELECT root, b FROM reach JOIN ways ON node = a),
label AS (SELECT root AS doc_id, min(node) AS c FROM reach GROUP BY root)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM s LEFT JOIN label USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir).select("doc_id", "text")
    return near_dedup.near_duplicates(docs, width=2).withColumnRenamed("id", "doc_id")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(docs_table(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", *quality.BASE_COUNTS, "base_failed", "kept")


@query("op10_substring_dedup", r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS s FROM d WHERE length(h) >= 200)),
f AS (SELECT k, min(doc_id * 4294967296 + s) AS first FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, s FROM w JOIN f USING (k) WHERE doc_id * 4294967296 + s > first),
n AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM n),
r AS (SELECT doc_id, min(s) AS s, max(s) + 100 AS e FROM i GROUP BY doc_id, island),
kept AS (
  SELECT doc_id, s AS place, substr(h, 2 * before + 1, 2 * (s - before)) AS piece
  FROM (SELECT doc_id, h, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r JOIN d USING (doc_id))
  UNION ALL
  SELECT doc_id, e, substr(h, 2 * e + 1) FROM (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) JOIN d USING (doc_id)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY place) AS h FROM kept GROUP BY doc_id),
counts AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(j.h, d.h))) AS kept_sha256
FROM d LEFT JOIN joined j USING (doc_id) LEFT JOIN counts USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeated_substrings(docs_table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(docs_table(spark, sf_dir).select("doc_id", "text"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(docs_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op7_url_filters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(docs_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")
