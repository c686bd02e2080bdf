"""Each stage of the pipeline on its own input, against a plain version of its rule."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from labelmill.llm import decontam, line_dedup, mixing, near_dedup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{base}/{i}")
        out.append((name, docs, spark.read.parquet(f"{base}/{i}")))
        docs = out[-1][2]
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns(stages):
    first = stages[0][1].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, *_ in stages] and all(out.columns == first for _, _, out in stages[:-1])


def test_quality_stage(stages):
    _, docs, out = stages[0]
    assert ids(out) == {r["doc_id"] for r in quality.judge_quality(docs).where("kept").collect()} and 0 < out.count() < docs.count()


def test_line_stage(stages):
    _, docs, out = stages[1]
    want = {(r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == want
    assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_near_stage(stages):
    _, docs, out = stages[2]
    assert ids(out) == {r["id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()} and out.count() <= docs.count()


def test_decontamination_stage(spark, stages):
    _, docs, out = stages[3]
    judged = decontam.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(out) == {r["doc_id"] for r in judged.where("NOT contaminated").collect()}


def test_mixing_stage(stages):
    """Rows as drawn: whole texts or, at a target's edge, their first words; sums meet the targets; nothing above twice its size."""
    _, docs, out = stages[4]
    before = {r["doc_id"]: r for r in docs.collect()}
    rows, words, drawn = out.collect(), re.compile(r"[^\x20\x09-\x0D]+"), {}
    size = {i: len(words.findall(r["text"] or "")) for i, r in before.items()}
    for r in rows:
        was = before[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and len(words.findall(r["text"])) == r["taken"] > 0 and r["source"] == was["source"]
        assert r["text"] == was["text"] if r["taken"] == r["size"] else was["text"].startswith(r["text"])
        drawn.setdefault(r["doc_id"], []).append(r["taken"])
    assert all(sum(n) <= 2 * size[i] for i, n in drawn.items())
    for source in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1 and sum(r["taken"] < r["size"] for r in of) <= 2
    assert {r["shard"] for r in rows} <= set(range(16))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.take(docs).collect()))


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[4][2].collect()))
