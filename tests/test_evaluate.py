import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import probability as pr
from labelmill.operators import evaluate
from labelmill.sources import readers


def scored(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, predicted_label int, prob array<double>")


def test_class_never_predicted(spark):
    df = scored(spark, [(1, 0, 0, [1.0, 0.0, 0.0]), (2, 1, 0, [0.9, 0.1, 0.0]), (3, 2, 2, [0.1, 0.1, 0.8])])
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.per_class(df).collect()}
    assert got[1] == (0.0, 0.0, 0.0, 1) and got[0] == (0.5, 1.0, pytest.approx(2 / 3), 1) and got[2] == (1.0, 1.0, 1.0, 1)
    m = evaluate.metrics(df).first()
    assert m["accuracy"] == pytest.approx(2 / 3) and m["f1_macro"] == pytest.approx(5 / 9)
    assert {r["label"]: (r["pred_0"], r["pred_1"], r["pred_2"]) for r in evaluate.confusion_matrix(df).collect()} == {
        0: (1, 0, 0), 1: (1, 0, 0), 2: (0, 0, 1)}


def test_auc_against_pair_counting(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), round(rng.random() ** 8, 3 if i % 2 else 1)) for i in range(600)]
    df = spark.createDataFrame([(0, label == 1, score) for label, score in rows], "class int, positive boolean, score double")
    pos = [s for label, s in rows if label == 1]
    neg = [s for label, s in rows if label != 1]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(pairs)
    ap, seen, hits = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        here = [label == 1 for label, x in rows if x == s]
        seen, hits = seen + len(here), hits + sum(here)
        ap += sum(here) / len(pos) * hits / seen
    assert evaluate.average_precision(df).first()["average_precision"] == pytest.approx(ap)
    last = evaluate.roc_points(df).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)
    assert evaluate.pr_points(df).filter("recall = 1").count() >= 1


def test_auc_limits(spark):
    equal = spark.createDataFrame([(0, i % 2 == 0, 0.5) for i in range(10)], "class int, positive boolean, score double")
    assert evaluate.roc_auc(equal).first()["auc"] == 0.5
    one_sided = equal.filter("positive")
    assert evaluate.roc_auc(one_sided).first()["auc"] is None and evaluate.roc_auc_macro(one_sided).first()[0] == 0.0


def test_enrich_and_errors(spark):
    df = scored(spark, [(1, 0, 1, [0.2, 0.7, 0.1]), (2, 1, 1, [0.1, 0.9, 0.0]), (3, 2, 1, [0.0, 0.9, 0.1]), (4, 0, 2, [0.0, 0.1, 0.9])])
    wrong = evaluate.misclassified(evaluate.enrich(df)).collect()
    assert [r["row_id"] for r in wrong] == [3, 4, 1]
    assert (wrong[0]["true_name"], wrong[0]["predicted_name"], wrong[0]["prob_Hate Speech"]) == ("Hate Speech", "Offensive", 0.1)


def test_softmax(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>").select(
        pr.softmax(F.col("l")).alias("p"), pr.argmax(F.col("l")).alias("k")).first()
    assert sum(row["p"]) == pytest.approx(1.0) and row["k"] == 1 and row["p"][1] == pytest.approx(0.4683, abs=1e-4)


def test_report_round_trip(spark, tmp_path):
    df = scored(spark, [(i, i % 3, (i * i) % 3, [0.1, 0.2, 0.7]) for i in range(100)])
    text = evaluate.report_text(df).first()["text"] + "\nROC-AUC (Macro): 0.9467\n"
    path = tmp_path / "report.txt"
    path.write_text(text)
    report = readers.read_report(spark, str(path))
    m = evaluate.metrics(df).first()
    got = readers.parse_report(report).first()
    assert got["accuracy"] == round(m["accuracy"], 4) and got["roc_auc_macro"] == 0.9467
    assert {r["name"]: r["support"] for r in readers.parse_report_classes(report).collect()} == {"Safe": 34, "Offensive": 33, "Hate Speech": 33}


def test_area_from_buckets_is_within_its_error(spark):
    rng = random.Random(3)
    rows = [(k, rng.random() < 0.3 + 0.2 * k, round(rng.random(), 3)) for k in range(3) for _ in range(400)] + [(0, True, 1.0), (0, False, 0.0)]
    df = spark.createDataFrame(rows, "class int, positive boolean, score double")
    exact = {r["class"]: r["auc"] for r in evaluate.roc_auc(df).collect()}
    for bins in (4, 50, 1 << 14):
        for r in evaluate.roc_auc_within(df, bins).collect():
            assert abs(r["auc"] - exact[r["class"]]) <= r["error"] + 1e-12
    areas = {r["class"]: r for r in evaluate.curve_areas(df).collect()}
    alone = {r["class"]: r["average_precision"] for r in evaluate.average_precision(df).collect()}
    assert {k: r["auc"] for k, r in areas.items()} == pytest.approx(exact) and {k: r["average_precision"] for k, r in areas.items()} == pytest.approx(alone)
    one_sided = df.filter("positive AND class = 1")
    assert [tuple(r) for r in evaluate.roc_auc_within(one_sided).collect()] == [(1, None, None)]
