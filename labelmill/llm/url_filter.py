"""URL filters: rules first, then naive Bayes over the words of host and path.

Host names write words together. The words and their counts are learnt from the text of all pages, titles and bodies; each distinct host label is split by the
most probable sequence of words (Viterbi over single-word probabilities). URLs that a rule decides train the classifier.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import Carried, ascii_lower, materialize, whole
from labelmill.llm.html_text import blocks_of

# Fixed values: (host, path) and verdict; a rule also fits all subdomains and all paths that begin with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LONGEST_WORD = 24
WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")  # letters of any script, with combining accents
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _page_words(batches):
    """Words and their counts, folded for each batch. A piece of a label has 2 to ``LONGEST_WORD`` letters; no other words can be met."""
    for batch in batches:
        counts = Counter()
        for page in batch.column(0):
            page = page.as_py()
            texts = [html.unescape(t) for t in TITLE.findall(page)] + [block.text() for block in blocks_of(page)]
            for text in texts:
                counts.update(w for w in WORD.findall(text.lower()) if 2 <= len(w) <= LONGEST_WORD)
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def page_words(pages: DataFrame, html_col: str) -> DataFrame:
    """``(word, n)`` over the titles and bodies of all pages; markup, scripts and styles are no text."""
    return pages.select(whole(html_col).alias("html")).mapInArrow(_page_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable split of a label; an unknown piece costs more the longer it is. Ties: the longer last word."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            n = known.get((start, end), 0)
            p = math.log(n / total) if n else -math.log(total + 1) - 2.3 * (end - start)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def _segment(total: int):
    def run(batches):
        for batch in batches:
            out = [viterbi(label, {(h["at"], h["at"] + len(h["word"])): h["n"] for h in hits or []}, total)
                   for label, hits in zip(batch.column("label").to_pylist(), batch.column("hits").to_pylist())]
            yield pa.record_batch([batch.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return run


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``(label, words)`` for distinct ``labels``; each label meets only the words that stand in it, by a join."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = F.sequence(F.lit(0), F.greatest(F.length("label") - 2, F.lit(0)))
    starts = labels.where(F.length("label") > 0).select("label", F.explode(at).alias("at"))
    cut = starts.select("label", "at", F.explode(F.sequence(F.lit(2), F.lit(LONGEST_WORD))).alias("size")).where(F.col("at") + F.col("size") <= F.length("label"))
    pieces = cut.select("label", "at", F.expr("substring(label, at + 1, size)").alias("word"))
    hits = pieces.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("at", "word", "n")).alias("hits"))
    return labels.join(hits, "label", "left").mapInArrow(_segment(max(total, 1)), "label string, words array<string>")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, smooth: float = 1.0) -> DataFrame:
    """``pages`` without ``html_col`` but with ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``host_words``.

    The longest rule that fits decides. Else naive Bayes does: ``score`` is the log odds of ``allow``, summed over the words of the host and
    the tokens of the path (digits as one sign), trained on all URLs that rules decide, with add-``smooth`` counts;
    0 or more allows. A null URL or one without ``://`` has empty host and path and is judged by the prior. A null id or repeated rows
    are judged like others. No rows: no rows. Columns with the names of the results are replaced.
    """
    names = ("host", "path", "rule", "verdict", "score", "host_words")
    rest = Carried(pages, *names, html_col)
    parsed = pages.select(*rest.cols, F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"))
    # Equal (host, path shape) pairs are judged once; most pages share few hosts.
    tokens_of_path = F.filter(F.split(ascii_lower(F.regexp_replace("path", "[0-9]+", "0")), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda t: t != "")
    shaped = parsed.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("_shape", F.array_join(tokens_of_path, "/"))
    shapes = materialize(shaped.groupBy("host", "_shape", "_rule").agg(F.count("*").alias("n")), "url-shapes")
    labels = shapes.select(F.explode(F.split("host", "[.]")).alias("label")).where("label <> ''").distinct()
    split = segment_labels(labels, materialize(page_words(pages, html_col), "page-words"))
    hosts = (shapes.select("host").distinct().select("host", F.posexplode(F.split("host", "[.]")).alias("i", "label")).join(materialize(split, "host-labels"), "label")
             .groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("host_words")))
    hosts = materialize(hosts, "host-words")
    spread = (shapes.join(hosts, "host", "left")
              .withColumn("tokens", F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
                                             F.transform(F.filter(F.split("_shape", "/"), lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t)))))
    spread = materialize(spread, "url-tokens")
    yes, no = F.when(F.col("_rule.verdict") == "allow", F.col("n")), F.when(F.col("_rule.verdict") == "block", F.col("n"))
    counts = (spread.where("_rule IS NOT NULL").select("_rule", "n", F.explode("tokens").alias("token"))
              .groupBy("token").agg(F.coalesce(F.sum(yes), F.lit(0)).alias("yes"), F.coalesce(F.sum(no), F.lit(0)).alias("no")))
    counts = materialize(counts, "url-counts")
    all_yes, all_no, kinds = counts.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0)), F.count("*")).first()
    docs_yes, docs_no = spread.agg(F.coalesce(F.sum(yes), F.lit(0)), F.coalesce(F.sum(no), F.lit(0))).first()
    prior = math.log((docs_yes + smooth) / (docs_no + smooth))
    weight = F.log((F.col("yes") + smooth) / (all_yes + smooth * (kinds + 1))) - F.log((F.col("no") + smooth) / (all_no + smooth * (kinds + 1)))
    unseen = math.log(all_no + smooth * (kinds + 1)) - math.log(all_yes + smooth * (kinds + 1))
    keyed = spread.select("host", "_shape", "host_words", "tokens").dropDuplicates(["host", "_shape"])
    gains = (keyed.select("host", "_shape", F.explode("tokens").alias("token")).join(counts.select("token", weight.alias("w")), "token", "left")
             .groupBy("host", "_shape").agg(F.sum(F.coalesce("w", F.lit(unseen))).alias("gain")))
    scores = keyed.select("host", "_shape", "host_words").join(gains, ["host", "_shape"], "left").select(
        F.col("host").alias("_host"), F.col("_shape").alias("_shape2"), F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"), (F.lit(prior) + F.coalesce("gain", F.lit(0.0))).alias("score"))
    joined = shaped.join(materialize(scores, "url-scores"), (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_shape2")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return joined.select(*rest.back(), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score", "host_words")
