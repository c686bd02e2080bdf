import hashlib

import pytest
from pyspark.sql import functions as F

from labelmill.config import Split
from labelmill.operators import qa, sampling, stats


@pytest.fixture(scope="module")
def rows(spark):
    """Class 0 holds half of all rows, class 2 only seven."""
    label = F.when(F.col("id") < 1000, 0).when(F.col("id") < 1993, 1).otherwise(2)
    return spark.range(2000).select(F.col("id").alias("row_id"), F.concat(F.lit("text "), "id").alias("text"), label.alias("label")).persist()


def by_hash(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}{i}".encode()).hexdigest())


def test_undersample_takes_the_first_by_hash(rows):
    got = [r["row_id"] for r in sampling.undersample(rows, 100).collect()]
    assert sorted(got) == sorted(by_hash(range(1000))[:100] + by_hash(range(1000, 1993))[:100] + list(range(1993, 2000)))
    assert sampling.undersample(rows, 0).count() == 2000
    assert sampling.presample(rows, 10).groupBy("label").count().filter("label = 0").first()["count"] == 30
    other = [r["row_id"] for r in sampling.undersample(rows, 100, seed=1).collect()]
    assert len(other) == 207 and other != got


def test_rank_and_subset(rows):
    ranked = {r["row_id"]: r["position"] for r in sampling.with_rank(rows).collect()}
    order = by_hash(range(2000))
    assert all(ranked[i] == k for k, i in enumerate(order, 1))
    assert sorted(r["row_id"] for r in sampling.random_subset(rows, 37).collect()) == sorted(order[:37])
    assert sampling.random_subset(rows, 5000).count() == 2000
    assert [r["row_id"] for r in sampling.shuffled(rows).collect()] == order


def test_stratified_split(rows):
    out = sampling.stratified_split(rows, Split(shares=(8, 1, 1)))
    meta = {r["split"]: r.asDict() for r in sampling.split_metadata(out).collect()}
    assert {s: (m["label_0"], m["label_1"], m["label_2"]) for s, m in meta.items()} == {
        "train": (800, 794, 6), "validation": (100, 100, 0), "test": (100, 99, 1)}
    assert out.count() == 2000 and [r["overlap"] for r in sampling.leakage(out).collect()] == [0, 0, 0]


def test_shuffle_split(rows):
    out = sampling.shuffle_split(rows.filter("row_id < 1999"))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 1599, "validation": 199, "test": 201}
    with pytest.raises(ValueError):
        sampling.shuffle_split(rows, Split(shares=(0.5, 0.1, 0.1)))


def test_oversample(rows):
    out = sampling.oversample(rows, 50)
    counts = {r["label"]: (r["n"], r["d"]) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).collect()}
    assert counts[0] == (50, 50) and counts[1] == (50, 50) and counts[2][0] == 50 and counts[2][1] <= 7
    assert sampling.oversample(rows, 50).exceptAll(out).count() == 0


def test_weights(spark, rows):
    counts = spark.createDataFrame([(0, 205117), (1, 45884), (2, 10250)], "label int, n int")
    big = counts.select("label", F.explode(F.sequence(F.lit(1), "n")))
    assert {r["label"]: r["weight"] for r in sampling.class_weights(big).collect()} == {0: 0.4246, 1: 1.8979, 2: 8.496}
    total = sum(r["n"] * r["weight"] for r in sampling.class_weights_fixed(rows).collect())
    assert total == pytest.approx(2000)
    fixed = {r["label"]: r["weight"] for r in sampling.class_weights_fixed(rows.filter("label < 2")).collect()}
    assert fixed[2] == 1.0 and fixed[0] == pytest.approx(1993 / 3000)


def test_leak_fails_the_gate(spark):
    df = spark.createDataFrame([("a", 0, "train"), ("a", 0, "test"), ("b", 1, "validation")], "text string, label int, split string")
    assert {r["pair"]: r["overlap"] for r in sampling.leakage(df).collect()} == {"train-validation": 0, "train-test": 1, "validation-test": 0}
    with pytest.raises(qa.QualityError, match="overlap train-test: 1"):
        qa.require_quality(qa.quality_checks(df))
    qa.require_quality(qa.quality_checks(df.filter("split <> 'test'")))


def test_gate_finds_bad_rows(spark):
    df = spark.createDataFrame([(None, 0, "train"), (" ", 5, "train"), ("x", None, "test")], "text string, label int, split string")
    bad = {(r["check"], r["subject"]): r["violations"] for r in qa.quality_checks(df).filter("not passed").collect()}
    assert bad == {("null_text", "train"): 1, ("blank_text", "train"): 1, ("invalid_label", "train"): 1, ("invalid_label", "test"): 1}
    assert {r["label"]: r["n"] for r in qa.invalid_labels(df).collect()} == {5: 1, None: 1}


def test_statistics(spark):
    df = spark.createDataFrame([("a b a", 0), ("b", 0), ("", 1)], "text string, label int")
    assert stats.length_stats(df).first().asDict() == {
        "total_samples": 3, "average_words": 1.33, "max_words": 3, "average_characters": 2.0, "max_characters": 5}
    assert stats.vocabulary_size(df).first()[0] == stats.vocabulary_size(df, approximate=True).first()[0] == 2
    assert [(r["word"], r["n"]) for r in stats.top_words(df, 2).collect()] == [("a", 2), ("b", 2)]
    assert {r["bin"]: r["n"] for r in stats.word_count_histogram(df).collect()} == {0: 1, 13: 1, 39: 1}
    assert {r["bin"]: r["n"] for r in stats.word_count_histogram(df.filter("text = 'b'")).collect()} == {20: 1}
