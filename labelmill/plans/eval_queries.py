"""Queries on evaluation: confusion family, curves, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import labels as lb
from labelmill.functions import probability as pr
from labelmill.operators import evaluate, model
from labelmill.plans.label_queries import FLAG_MAP
from labelmill.plans.registry import query, table
from labelmill.sources import readers

# Truth = return flag, prediction = a rule on the quantity, scores = three numeric columns with many ties.
SCORED_SQL = """s AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS label,
  CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS pred,
  [l_discount, l_tax, l_quantity / 50] AS prob FROM lineitem)"""


def _scored(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").withColumns({
        "label": lb.map_code(F.col("l_returnflag"), FLAG_MAP),
        "predicted_label": F.when(q < 17, 0).when(q < 34, 1).otherwise(2),
        "prob": F.array("l_discount", "l_tax", q / 50),
    })


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


PER_CLASS_SQL = f"""{SCORED_SQL}, cls AS (SELECT k AS label, count(*) FILTER (s.label = k AND pred = k) AS tp,
  count(*) FILTER (pred = k) AS claimed, count(*) FILTER (s.label = k) AS support FROM s, (VALUES (0), (1), (2)) v(k) GROUP BY k),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(claimed, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(claimed + support, 0), 0) AS f1 FROM cls)"""


@query(f"""WITH {SCORED_SQL} SELECT label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1,
  count(*) FILTER (pred = 2) AS pred_2 FROM s GROUP BY label""")
def confusion(spark, d):
    return evaluate.confusion_matrix(_scored(spark, d))


@query(f"WITH {SCORED_SQL} SELECT label, pred AS predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion_counts(spark, d):
    return evaluate.confusion_counts(_scored(spark, d))


METRICS_SQL = """round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted"""


@query(f"WITH {PER_CLASS_SQL} SELECT {METRICS_SQL} FROM m")
def macro_metrics(spark, d):
    out = evaluate.metrics(_scored(spark, d))
    return _rounded(out, *out.columns)


NAME = "CASE label WHEN 0 THEN 'Safe' WHEN 1 THEN 'Offensive' ELSE 'Hate Speech' END"


@query(f"""WITH {PER_CLASS_SQL} SELECT {NAME} AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m""")
def class_report(spark, d):
    return _rounded(evaluate.classification_report(_scored(spark, d)), "precision", "recall", "f1")


@query(f"""WITH {PER_CLASS_SQL} SELECT round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(precision), 4) AS precision_macro,
  round(avg(recall), 4) AS recall_macro, round(avg(f1), 4) AS f1_macro, 0.0::DOUBLE AS roc_auc_macro FROM m""")
def report_scores(spark, d):
    """The text report written and read back by pattern; it carries no ROC line, which then reads 0."""
    return readers.parse_report(evaluate.report_text(_scored(spark, d)), "text")


@query(f"""WITH {PER_CLASS_SQL} SELECT {NAME} AS name, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support FROM m""")
def report_classes(spark, d):
    return readers.parse_report_classes(evaluate.report_text(_scored(spark, d)), "text")


CURVE_SQL = f"""{SCORED_SQL}, pts AS (SELECT k AS class, prob[k + 1] AS score, count(*) FILTER (label = k) AS pos,
  count(*) FILTER (label <> k) AS neg FROM s, (VALUES (0), (1), (2)) v(k) GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER c AS p, sum(neg) OVER c AS n FROM pts
  WINDOW w AS (PARTITION BY class ORDER BY score DESC), c AS (PARTITION BY class))"""


def _curve(spark, d):
    return evaluate.one_vs_rest(_scored(spark, d))


AUC_SQL = "sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n))"


@query(f"WITH {CURVE_SQL} SELECT class, round({AUC_SQL}, 6) AS auc FROM cum GROUP BY class")
def roc_auc(spark, d):
    return _rounded(evaluate.roc_auc(_curve(spark, d)), "auc")


BINS_SQL = f"""{SCORED_SQL}, b AS (SELECT k AS class, least(floor(prob[k + 1] * 16384), 16383) AS bucket, count(*) FILTER (label = k) AS pos,
  count(*) FILTER (label <> k) AS neg FROM s, (VALUES (0), (1), (2)) v(k) GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY bucket DESC) AS tp FROM b)"""


@query(f"""WITH {BINS_SQL} SELECT class, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc,
  round(sum(pos * neg / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(neg)), 6) AS error FROM cum GROUP BY class""")
def roc_auc_within(spark, d):
    return _rounded(evaluate.roc_auc_within(_curve(spark, d)), "auc", "error")


@query(f"""WITH {CURVE_SQL} SELECT class, round({AUC_SQL}, 6) AS auc, round(sum(pos::DOUBLE / p * tp / (tp + fp)), 6) AS average_precision FROM cum GROUP BY class""")
def curve_areas(spark, d):
    return _rounded(evaluate.curve_areas(_curve(spark, d)), "auc", "average_precision")


@query(f"WITH {CURVE_SQL} SELECT round(avg(auc), 6) AS roc_auc_macro FROM (SELECT {AUC_SQL} AS auc FROM cum GROUP BY class)")
def roc_auc_macro(spark, d):
    return _rounded(evaluate.roc_auc_macro(_curve(spark, d)), "roc_auc_macro")


@query(f"""WITH {CURVE_SQL} SELECT class, round(score, 6) AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT class, 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cum""")
def roc_points(spark, d):
    points = evaluate.roc_points(_curve(spark, d))
    above = F.when(F.col("threshold") == float("inf"), 2.0).otherwise(F.col("threshold"))
    return _rounded(points.withColumn("threshold", above), "threshold", "fpr", "tpr")


@query(f"""WITH {CURVE_SQL} SELECT class, round(score, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision,
  round(tp::DOUBLE / p, 6) AS recall FROM cum""")
def pr_points(spark, d):
    return _rounded(evaluate.pr_points(_curve(spark, d)), "threshold", "precision", "recall")


@query(f"""WITH {CURVE_SQL} SELECT class, round(sum(pos::DOUBLE / p * tp / (tp + fp)), 6) AS average_precision FROM cum GROUP BY class""")
def avg_precision(spark, d):
    return _rounded(evaluate.average_precision(_curve(spark, d)), "average_precision")


ENRICHED_SQL = f"""{SCORED_SQL}, e AS (SELECT *, CASE label WHEN 0 THEN 'Safe' WHEN 1 THEN 'Offensive' ELSE 'Hate Speech' END AS true_name,
  CASE pred WHEN 0 THEN 'Safe' WHEN 1 THEN 'Offensive' ELSE 'Hate Speech' END AS predicted_name,
  prob[1] AS "prob_Safe", prob[2] AS "prob_Offensive", prob[3] AS "prob_Hate Speech", list_max(prob) AS confidence FROM s)"""
SHOWN = ("l_orderkey", "l_linenumber", "true_name", "predicted_name", "prob_Safe", "prob_Offensive", "prob_Hate Speech", "confidence")
SHOWN_SQL = ", ".join(f'"{c}"' for c in SHOWN)


@query(f"WITH {ENRICHED_SQL} SELECT {SHOWN_SQL} FROM e")
def scored_rows(spark, d):
    return evaluate.enrich(_scored(spark, d)).select(*SHOWN)


TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH {ENRICHED_SQL} SELECT {SHOWN_SQL}, l_partkey, l_suppkey, l_extendedprice FROM e WHERE label <> pred
ORDER BY confidence DESC, {", ".join(TIE_BREAK)} LIMIT 100""")
def hard_errors(spark, d):
    wrong = evaluate.misclassified(evaluate.enrich(_scored(spark, d)), id_cols=TIE_BREAK, top=100)
    return wrong.select(*SHOWN, "l_partkey", "l_suppkey", "l_extendedprice")


@query("""WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings),
e AS (SELECT vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) AS a FROM z)
SELECT vec_id, (list_position(l, list_max(l)) - 1)::INT AS class, round(a[1] / list_sum(a), 6) AS first, round(a[-1] / list_sum(a), 6) AS last,
  round(1.0 / list_sum(a) * 100, 2) AS confidence FROM e""")
def softmax_argmax(spark, d):
    """All 64 values of a vector as the scores of 64 classes."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", pr.softmax(logits).alias("p"))
    return rows.select("vec_id", pr.argmax(F.col("p")).alias("class"), F.round(F.element_at("p", 1), 6).alias("first"),
                       F.round(F.element_at("p", -1), 6).alias("last"), pr.percent(F.array_max("p")).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE o_orderstatus END AS prediction,
  CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE o_totalprice END AS confidence FROM orders""")
def missing_probability(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("prediction"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("confidence"))
    return model.complete_response(orders, numbers=("confidence",))
