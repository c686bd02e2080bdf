import pytest
from pyspark.sql import functions as F

from labelmill import schemas
from labelmill.functions import labels as lb
from labelmill.operators import normalize, validate


def test_code_maps(spark):
    code = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 9)], schemas.SRC_CODE)
    assert [r["label"] for r in normalize.normalize_code(code).collect()] == [2, 1, 0, None]
    binary = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5)], schemas.SRC_BINARY)
    assert [r["label"] for r in normalize.normalize_binary(binary).collect()] == [0, 1, None]
    assert [r["label"] for r in normalize.normalize_binary(binary, nonzero=True).collect()] == [0, 1, 1]


@pytest.mark.parametrize(
    ("votes", "severity", "first_seen"),
    [
        (["normal", "offensive", "hatespeech"], 2, 0),
        (["normal", "normal", "hatespeech"], 0, 0),
        (["offensive", "normal"], 1, 1),
        (["normal", "offensive", "offensive", "normal"], 1, 0),
        (["strange", "strange", "offensive"], 0, 0),
        ([], None, None),
    ],
)
def test_votes(spark, votes, severity, first_seen):
    row = spark.createDataFrame([(votes,)], "v array<string>").select(
        lb.vote_in_row(F.col("v")).alias("s"), lb.vote_in_row(F.col("v"), ties="first_seen").alias("f")).first()
    assert (row["s"], row["f"]) == (severity, first_seen)


def test_flag_and_score_rules(spark):
    flags = spark.createDataFrame([("1", "x", 0, 0, 0, 1, 0, 0), ("2", "x", 0, 0, 1, 0, 0, 0), ("3", "x", 0, 0, 0, 0, 0, 0)], schemas.SRC_FLAGS)
    assert [r["label"] for r in normalize.normalize_flags(flags).collect()] == [2, 1, 0]
    n = None
    scores = spark.createDataFrame(
        [("a", n, n, n, n, n, n, n), ("b", 0.5, n, n, n, n, n, n), ("c", 0.0, n, n, 0.5, n, n, n), ("d", n, n, n, n, n, n, 0.49)],
        schemas.SRC_SCORES)
    assert [r["label"] for r in normalize.normalize_scores(scores).collect()] == [0, 1, 2, 0]


def test_label_names(spark):
    got = spark.createDataFrame([(0,), (1,), (2,), (7,)], "l int").select(lb.label_name(F.col("l"))).collect()
    assert [r[0] for r in got] == ["Safe", "Offensive", "Hate Speech", "Class 7"]


def test_validation_summary_and_valid_rows(spark):
    rows = [(1, "a", 0, "s"), (2, "a", 1, "s"), (3, None, 1, "s"), (4, " \t", 1, "s"), (5, "b", None, "s"), (5, "c", 0, "s"), (6, "a", 0, "t")]
    df = spark.createDataFrame(rows, "row_id long, text string, label int, source string")
    got = {r["source"]: r.asDict() for r in validate.validation_summary(df, "text", ["label"], id_col="row_id").collect()}
    assert got["s"] == {"source": "s", "total_raw_rows": 6, "null_text_samples": 1, "empty_text_samples": 1, "missing_label": 1,
                        "duplicate_texts": 1, "total_clean_rows": 2, "removed_corrupted_or_invalid_rows": 4, "duplicate_ids": 1}
    assert sorted((r["row_id"], r["text"]) for r in validate.valid_rows(df, "text", ["label"]).collect()) == [(1, "a"), (5, "c")]
    assert validate.missing_columns(df, "body", ["label", "other"]) == ["body", "other"]
    with pytest.raises(ValueError, match="body"):
        validate.valid_rows(df, "body", ["label"])


def test_nested_validation(spark):
    ok, no_label = [("normal",)], [("normal",), (None,)]
    rows = [("1", ["a", "b"], ok), ("2", [], ok), ("3", None, ok), ("4", [" ", ""], ok), ("5", ["x"], []), ("6", ["x"], no_label),
            ("1", ["a", "b"], ok), ("7", ["a", "b"], ok)]
    df = spark.createDataFrame(rows, schemas.SRC_ANNOTATED)
    assert validate.nested_summary(df).first().asDict() == {
        "total_raw_rows": 8, "corrupted": 4, "empty_text_samples": 1, "duplicate_ids": 1, "duplicate_texts": 1,
        "total_clean_rows": 2, "removed_corrupted_or_invalid_rows": 6}


def test_vote_by_key_with_one_huge_key(spark):
    votes = spark.range(30000).select(
        F.when(F.col("id") < 10000, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).cast("int").alias("v"), "id")
    got = {r["k"]: r for r in normalize.vote_by_key(votes, "k", F.col("v")).filter("k in (0, 20001)").collect()}
    assert (got[0]["label"], got[0]["votes"]) == (0, 3334) and got[20001]["label"] == 0
