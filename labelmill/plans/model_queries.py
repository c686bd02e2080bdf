"""Queries that train a model on the labelled documents and use it (iterative: no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.config import LABEL_NAMES, Split
from labelmill.operators import evaluate, model, sampling
from labelmill.plans.registry import documents, labelled, query, table
from labelmill.storage import materialize

# Small, because the queries run on small scale factors as well.
SETTING = model.Hyperparameters(max_iter=15, buckets=1 << 16)


def _prepared(spark, d):
    rows = model.prepare_for_scoring(labelled(spark, d))
    return materialize(sampling.stratified_split(rows, Split()), "prepared")


def _trained(rows):
    return model.train(rows.filter("split = 'train'"), SETTING)


@query()
def batch_score(spark, d):
    """Clean all documents once, train on the labelled ones, score all."""
    ready = materialize(model.prepare_for_scoring(documents(spark, d).select("row_id", "text")), "prepared-all")
    rows = ready.join(labelled(spark, d).select("row_id", "label"), "row_id")
    fitted = _trained(materialize(sampling.stratified_split(rows, Split()), "prepared"))
    out = model.score(ready, fitted, prepared=True)
    return out.select("row_id", "prediction_name", "confidence", "probabilities")


@query("SELECT doc_id AS row_id, true AS sums_to_100, true AS is_likeliest, true AS is_confidence, true AS in_range FROM documents")
def batch_score_checks(spark, d):
    """What must hold for each scored document, whatever the model: one row each, shares of 100 percent, the likeliest class wins."""
    shares = F.map_values("probabilities")
    checks = {
        "sums_to_100": F.abs(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) - 100) <= 0.05,
        "is_likeliest": F.col("probabilities")[F.col("prediction_name")] == F.array_max(shares),
        "is_confidence": F.col("confidence") == F.array_max(shares),
        "in_range": F.forall(shares, lambda x: x.between(0, 100)),
    }
    return batch_score(spark, d).select("row_id", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()])


@query("""SELECT conv_id AS request_id, count(*) AS n_texts, count(*) AS n_predictions, true AS in_domain, true AS in_order,
  NULL::VARCHAR AS message FROM conversations GROUP BY conv_id
UNION ALL SELECT c_custkey, 0, 0, true, true, 'List should have at least 1 item' FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM conversations)""")
def batch_requests(spark, d):
    """A request for each conversation, its turns as a list, and empty ones for customers without one; every list is answered in its order."""
    talk, customers = table(spark, d, "conversations"), table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"))
    lists = talk.groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    empty = customers.join(lists, "request_id", "left_anti").withColumn("texts", F.array().cast("array<string>"))
    requests = lists.select("request_id", F.transform("t", lambda r: r["text"]).alias("texts")).unionByName(empty)
    fitted = _trained(_prepared(spark, d))
    answered = model.score_batches(model.quarantine_batches(requests), fitted)
    # Each turn scored alone must stand at its own place of the answer.
    alone = model.score(talk, fitted).groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "prediction_name", "confidence"))).alias("one"))
    same = F.coalesce(F.transform("one", lambda r: F.struct(r["prediction_name"].alias("prediction_name"), r["confidence"].alias("confidence"))) == F.col("predictions"), F.size("predictions") == 0)
    known = F.forall("predictions", lambda p: p["prediction_name"].isin(*LABEL_NAMES.values()) & p["confidence"].between(0, 100))
    size = lambda c: F.size(c).cast("long")
    return answered.join(alone, "request_id", "left").select("request_id", size("texts").alias("n_texts"), size("predictions").alias("n_predictions"),
                                                             known.alias("in_domain"), same.alias("in_order"), "message")


@query()
def validation_metrics(spark, d):
    rows = _prepared(spark, d)
    scored = model.score(rows.filter("split <> 'train'"), _trained(rows), prepared=True)
    return evaluate.metrics(scored)


@query()
def model_curves(spark, d):
    rows = _prepared(spark, d)
    scored = model.score(rows, _trained(rows), prepared=True)
    return evaluate.curve_areas(evaluate.one_vs_rest(scored))


@query()
def token_importance(spark, d):
    rows = _prepared(spark, d)
    return model.token_importance(rows, _trained(rows), prepared=True)


@query()
def hyperparameter_search(spark, d):
    rows = _prepared(spark, d)
    best, f1 = model.tune(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), trials=2, start=SETTING)
    # the whole table is then scored with the setting found
    fitted = model.train(rows.filter("split = 'train'"), best)
    scored = model.score(rows, fitted, prepared=True)
    return evaluate.metrics(scored).withColumn("search_f1", F.lit(f1))
