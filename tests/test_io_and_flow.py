import json
import os

import pytest
from pyspark.sql import functions as F

from labelmill import schemas
from labelmill.config import Split
from labelmill.operators import history, model, names, noise, qa, sampling, validate
from labelmill.plans import corpus
from labelmill.sources import readers, writers
from labelmill.storage import clear_work, deal_out, materialize, new_path, shared_dir, work_dir
from labelmill.streaming import jobs

WORDS = {0: ("sunny garden tea friend music", 0), 1: ("noisy silly rude clown nonsense", 1), 2: ("vile enemy horde banish scum", 2)}


def sentences(n, offset=0):
    out = []
    for i in range(offset, offset + n):
        k = i % 3
        words = WORDS[k][0].split()
        out.append((f"The {words[i % 5]} and the {words[(i // 5) % 5]} number{i} are {words[(i // 25) % 5]} x{i} y{i * 7} today", k))
    return out


def test_csv_encodings(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_bytes('tweet,class\n"café, ""quoted""\nsecond line",1\n'.encode("utf-8"))
    (folder / "b.csv").write_bytes("tweet,class\nna\xefve,2\nNA,0\n".encode("latin-1"))
    kinds = {r["path"][-5:]: r["encoding"] for r in readers.file_encodings(spark, str(folder)).collect()}
    assert kinds == {"a.csv": "utf-8", "b.csv": "latin-1"}
    got = {(r["tweet"], r["class"]) for r in readers.read_csv(spark, str(folder), schemas.SRC_CODE).collect()}
    assert got == {('café, "quoted"\nsecond line', 1), ("naïve", 2), ("NA", 0)}


def test_many_files_in_both_encodings(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = set()
    for i in range(200):
        text = f"é{i} naïve, \"so\"\nline  "
        quoted = '"' + text.replace('"', '""') + '"'
        (folder / f"f{i}.csv").write_bytes(f"tweet,class\n{quoted},{i}\n".encode("latin-1" if i % 3 == 0 else "utf-8"))
        want.add((text, i))
    df = readers.read_csv(spark, str(folder), schemas.SRC_CODE)
    assert df.columns == ["tweet", "class"] and {tuple(r) for r in df.collect()} == want


def test_csv_without_files_of_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("tweet,class\n")
    assert readers.read_csv(spark, str(tmp_path), schemas.SRC_CODE).collect() == []


def test_written_files_are_checked_as_bytes(spark, tmp_path):
    texts = [" ends with space ", "quote \" and, comma", "two\nlines", "é漢😀", None, ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], schemas.SRC_CODE)
    writers.write_csv(df.repartition(3), str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), schemas.SRC_CODE)
    assert {tuple(r) for r in back.collect()} == {(t or None, i) for i, t in enumerate(texts)}
    assert all(r["passed"] for r in qa.file_checks(spark, str(tmp_path / "csv")).collect())
    (tmp_path / "csv" / "bad.csv").write_bytes(b"tweet,class\nna\xefve,2\nplain,1\n")
    failed = qa.file_checks(spark, str(tmp_path / "csv")).filter("NOT passed").collect()
    assert [(r["subject"][-7:], r["violations"]) for r in failed] == [("bad.csv", 1)]


def test_source_report(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("tweet,class\nplain,1\nplain,\ncafé,2\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("tweet,class\nna\xefve,2\n,0\n".encode("latin-1"))
    rows = readers.read_csv(spark, str(tmp_path), schemas.SRC_CODE)
    folder = readers.file_encodings(spark, str(tmp_path))
    named = rows.withColumn("source", F.when(F.col("tweet").contains("ï") | F.col("tweet").isNull(), "b.csv").otherwise("a.csv"))
    encodings = folder.withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {r["source"]: r for r in validate.source_report(named, "tweet", ["class", "votes"], encodings=encodings).collect()}
    assert (got["a.csv"]["encoding"], got["b.csv"]["encoding"]) == ("utf-8", "latin-1")
    assert all(r["missing_columns"] == ["votes"] and r["missing_votes"] == r["total_raw_rows"] and r["total_clean_rows"] == 0 for r in got.values())
    assert (got["a.csv"]["missing_class"], got["a.csv"]["duplicate_texts"], got["b.csv"]["null_text_samples"]) == (1, 1, 1)
    whole = {r["source"]: r for r in validate.source_report(named, "tweet", ["class"]).collect()}
    assert whole["a.csv"]["missing_columns"] == [] and whole["a.csv"]["encoding"] is None and whole["a.csv"]["total_clean_rows"] == 2
    assert validate.source_report(named.limit(0), "tweet", ["class", "votes"]).collect() == []


@pytest.mark.parametrize("sent", [20_000, 1, 0])
def test_names_of_a_table(spark, sent):
    texts = ["Yesterday Mary Smith met john, Peter.", "Peter Peter Pan pan", "", None, "nobody here", "Mary"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    lexicon = spark.createDataFrame([("Mary",), ("Peter",), ("Peter",), (None,)], "name string")
    got = {r["row_id"]: r["text"] for r in names.mask_names_by(df, lexicon, sent=sent).collect()}
    assert got == {0: "Yesterday someone someone met john , someone .", 1: "someone someone someone pan", 2: "", 3: None, 4: "nobody here", 5: "someone"}
    none = {r["row_id"]: r["text"] for r in names.mask_names_by(df, lexicon.limit(0), sent=sent).collect()}
    assert none[0] == "Yesterday Mary Smith met john , Peter ." and none[3] is None


def test_nested_json(spark, tmp_path):
    posts = {"p1": {"post_tokens": ["a", "b"], "annotators": [{"label": "normal"}]}, "p2": {"post_tokens": [], "annotators": []}}
    (tmp_path / "posts.json").write_text(json.dumps(posts, indent=1))
    got = {r["post_id"]: r["post_tokens"] for r in readers.read_annotated(spark, str(tmp_path / "posts.json")).collect()}
    assert got == {"p1": ["a", "b"], "p2": []}


def test_first_rows(spark):
    df = spark.range(0, 100000, 7).withColumnRenamed("id", "row_id")
    assert [r[0] for r in readers.first_rows(df, 50).orderBy("row_id").collect()] == [7 * i for i in range(50)]
    assert readers.first_rows(df, 10**6).count() == df.count()


def test_log_and_export(spark, tmp_path):
    line = {"ts": "2024-01-01T00:00:00Z", "event": "api_request", "client_ip": "-", "method": "GET", "path": "/health", "status_code": 200, "duration_ms": 1.234}
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({**line, "path": p}) for p in ("/health", "/predict")))
    log = history.request_log(readers.read_log(spark, str(tmp_path / "log.jsonl"), schemas.REQUEST_LOG))
    assert [(r["path"], r["duration_ms"]) for r in log.collect()] == [("/predict", 1.23)]
    items = spark.createDataFrame([("1", 'say "hi", you', "Safe", 99.0, (99.0, 1.0, 0.0), 3.0, None), ("2", "Rude", "Offensive", 80.0, (10.0, 80.0, 10.0), 5.0, None)], schemas.HISTORY)
    writers.write_csv(history.export_rows(items).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.splitlines()[0].startswith("Timestamp,Comment text,Prediction") and '"say ""hi"", you"' in text
    assert history.mean_latency(items).first()[0] == "4.0ms" and history.mean_latency(history.clear(items)).first()[0] == "~12ms"
    assert [r["id"] for r in history.search(items, "RUDE").collect()] == ["2"]
    assert [r["id"] for r in history.search(items, "", "Safe").collect()] == ["1"]
    assert [r["id"] for r in history.delete_by_id(items, items.filter("id = '1'")).collect()] == ["2"]


def test_requests(spark):
    df = spark.createDataFrame([("ok text",), ("",), (None,), ("a " * 9,)], "text string")
    got = [(r["field"], r["message"]) for r in model.quarantine(df, word_limit=5).collect()]
    assert got == [(None, None), ("text", "String should have at least 1 character"), ("text", "Field required"), ("text", "Text has more than 5 words")]
    batches = spark.createDataFrame([([],), (["a"],)], "texts array<string>")
    assert [r["message"] for r in model.quarantine_batches(batches).collect()] == ["List should have at least 1 item", None]


def test_storage(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(5), "five").count() == 5
    assert deal_out(spark.range(10), 3, "id").rdd.getNumPartitions() == 3 and deal_out(spark.range(10), 0, "id").count() == 10
    assert new_path(spark, "x").startswith(work_dir(spark))


def test_clear_work(spark, monkeypatch, tmp_path):
    five = materialize(spark.range(5), "five")
    monkeypatch.setattr("labelmill.storage.shared_dir", lambda spark: str(tmp_path))
    assert materialize(five, "six").count() == 5 and os.path.exists(work_dir(spark))
    clear_work(spark)
    assert not os.path.exists(work_dir(spark)) and five.count() == 5


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    texts = sentences(300)
    code = spark.createDataFrame([(t, {0: 2, 1: 1, 2: 0}[k]) for t, k in texts[:150]] + [("Same text for both sides here", 1), (None, 1)], schemas.SRC_CODE)
    binary = spark.createDataFrame([(t, min(k, 1)) for t, k in texts[150:250]] + [("same TEXT for both sides here ", 0), ("12345", 0)], schemas.SRC_BINARY)
    flags = spark.createDataFrame([(str(i), t, int(k == 1), 0, 0, int(k == 2), 0, 0) for i, (t, k) in enumerate(texts[250:])], schemas.SRC_FLAGS)
    scores = spark.createDataFrame([("Le chien est dans la forêt et les bois", *([0.0] * 7))], schemas.SRC_SCORES)
    posts = spark.createDataFrame([("p", ["some", "plain", "words"], [("normal",), ("normal",)]), ("q", [], [])], schemas.SRC_ANNOTATED)
    raws = {"davidson": code, "olid": binary, "hatexplain": posts, "jigsaw": flags, "civil_comments": scores}
    out = str(tmp_path_factory.mktemp("corpus"))
    return corpus.build_corpus(corpus.unify_sources(raws), out, split=Split(per_class=60)), out


def test_bad_label_fails_the_gate(spark, tmp_path):
    rows = [(i, t, k, "s") for i, (t, k) in enumerate(sentences(60))] + [(900 + i, f"{t} and more of it", None if i else 7, "s") for i, (t, _) in enumerate(sentences(4))]
    unified = spark.createDataFrame(rows, schemas.UNIFIED)
    with pytest.raises(qa.QualityError, match="invalid_label merged: 4"):
        corpus.build_corpus(unified, str(tmp_path / "a"), language=None, split=Split(per_class=0))
    tables = corpus.build_corpus(unified, str(tmp_path / "b"), language=None, split=Split(per_class=0), gate=False)
    assert tables["rejected"].count() == 4 and tables["splits"].count() + 4 == tables["merged"].count()


def test_corpus_flow(spark, built):
    tables, out = built
    stat = tables["merge_statistics"].first()
    counted = noise.noise_stats(tables["cleaned"].filter("drop_reason IS NULL").drop("is_noise", *noise.RULES)).first().asDict()
    seen = tables["noise_stats"].first().asDict()
    assert seen.pop("rows") == stat["total_merged_input"] and seen == counted and seen["only_numbers"] == 1
    assert stat["conflicts_detected"] == 1 and stat["only_numbers"] == 1 and stat["total_output_rows"] == tables["merged"].count()
    resolved = tables["merged"].filter("text = 'same text for both sides here'").collect()
    assert [(r["label"], r["source"]) for r in resolved] == [(1, "davidson|olid")]
    assert tables["cleaned"].filter("drop_reason = 'language'").count() == 1
    assert all(r["passed"] for r in tables["checks"].collect())
    counts = {r["label"]: r["count"] for r in tables["splits"].groupBy("label").count().collect()}
    assert counts[0] == 60 and counts[1] == 60
    document = spark.read.json(f"{out}/dataset_statistics").first()
    assert document["total_samples"] == tables["merged"].count() and len(document["top_frequent_words"]) == 20


def test_legacy_flow(spark):
    rows = [(i, t, k, "s") for i, (t, k) in enumerate(sentences(120))] + [(900, "One disputed text of two labels", 0, "s"), (901, "one disputed text of two labels!!", 1, "s")]
    unified = spark.createDataFrame(rows, schemas.UNIFIED)
    out = corpus.build_legacy(unified, language=None, split=Split(per_class=50))
    counts = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert all(counts["train", k] == 40 for k in range(3))
    assert [r["overlap"] for r in sampling.leakage(out, "clean_text").collect()] == [0, 0, 0]


def test_model(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(sentences(240))], "row_id long, text string, label int")
    prepared = materialize(model.prepare_for_scoring(rows), "prepared")
    fitted = model.train(prepared, model.Hyperparameters(max_iter=20, buckets=4096))
    model.save(fitted, str(tmp_path / "model"))
    fitted = model.load(str(tmp_path / "model"))
    fresh = spark.createDataFrame([(1, "a vile scum horde"), (2, "sunny tea in the garden"), (3, "   ")], "row_id long, text string")
    got = {r["row_id"]: r for r in model.score(fresh, fitted).collect()}
    assert (got[1]["prediction_name"], got[2]["prediction_name"]) == ("Hate Speech", "Safe") and len(got) == 3
    assert sum(got[1]["probabilities"].values()) == pytest.approx(100, abs=0.05) and got[1]["confidence"] == max(got[1]["probabilities"].values())
    assert model.score(fresh.limit(0), fitted).count() == 0
    parts = model.token_importance(fresh.filter("row_id = 1"), fitted).orderBy("position").collect()
    assert [r["token"] for r in parts] == ["a", "vile", "scum", "horde"] and parts[1]["importance_score"] > 0 and parts[0]["is_special"]
    assert model.MacroF1Evaluator().evaluate(fitted.transform(prepared)) > 0.9
    timed = model.score_timed(fresh, fitted, lambda df: df.write.format("noop").mode("overwrite").save())
    assert timed["rows"] == 3 and timed["total_processing_time_ms"] > 0

    calls = []

    def sometimes(df, hp):
        calls.append(hp)
        if len(calls) == 1:
            raise RuntimeError("no luck")
        return fitted

    best, f1 = model.tune(prepared, prepared, trials=3, fit=sometimes)
    assert len(calls) == 3 and best in calls[1:] and f1 > 0.9


def test_streams(spark, tmp_path):
    source, sink, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "ts timestamp, text string, label int"

    def arrive(rows):
        spark.createDataFrame(rows, "ts string, text string, label int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    arrive([("2024-01-01 00:01:00", "Hello there", 0), ("2024-01-01 00:02:00", "hello THERE ", 0), ("2024-01-01 00:03:00", "exit", 0), ("2024-01-01 01:00:00", "bye", 2)])

    def run():
        stream = jobs.drop_control_words(jobs.read_stream(spark, source, schema))
        jobs.start_append(jobs.dedup_stream(stream, ts="ts"), sink, check).awaitTermination()
        return sorted(r["label"] for r in spark.read.parquet(sink).collect())

    assert run() == [0, 2]
    assert run() == [0, 2]  # a restart on the same checkpoint adds nothing
    arrive([("2024-01-01 01:01:00", "BYE", 1), ("2024-01-01 01:02:00", "new words", 1)])
    assert run() == [0, 1, 2]

    counts = jobs.class_counts_stream(jobs.read_stream(spark, source, schema), "ts", "label")
    jobs.start_update(counts, sink + "-counts", check + "-counts").awaitTermination()
    got = {(r["window_start"].hour, r["label"]): r["n"] for r in jobs.read_current(spark, sink + "-counts", ["window_start", "label"]).collect()}
    batch = spark.read.parquet(source).groupBy(F.hour("ts").alias("h"), "label").count().collect()
    assert got == {(r["h"], r["label"]): r["count"] for r in batch}


def test_late_rows(spark, tmp_path):
    """A row that comes after its window was closed is dropped; counts that change come out again under the newest batch."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, value double, label int"

    def arrive(*rows):
        spark.createDataFrame(list(rows), "ts string, value double, label int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        read = lambda: jobs.read_stream(spark, source, schema)
        jobs.start_append(jobs.log_stats_stream(read(), "ts", "value"), sink + "-a", sink + "-ac").awaitTermination()
        jobs.start_update(jobs.class_counts_stream(read(), "ts", "label"), sink + "-u", sink + "-uc").awaitTermination()

    arrive(("2024-01-01 00:10:00", 1.0, 0), ("2024-01-01 09:00:00", 5.0, 0))
    run()
    arrive(("2024-01-01 00:20:00", 99.0, 0), ("2024-01-01 09:30:00", 7.0, 0), ("2024-01-01 20:00:00", 1.0, 0))
    run()
    windows = {r["window_start"].hour: (r["n"], r["mean"]) for r in spark.read.parquet(sink + "-a").collect()}
    assert windows == {0: (1, 1.0), 9: (2, 6.0)}  # the hour 20 is still open, the late row of hour 0 is gone
    counts = {r["window_start"].hour: r["n"] for r in jobs.read_current(spark, sink + "-u", ["window_start", "label"]).collect()}
    assert counts == {0: 1, 9: 2, 20: 1}


def test_batches_of_texts(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(sentences(60))], "row_id long, text string, label int")
    fitted = model.train(materialize(model.prepare_for_scoring(rows), "prepared"), model.Hyperparameters(max_iter=10, buckets=1024))
    asked = spark.createDataFrame([(1, ["a vile scum horde", "sunny tea in the garden"]), (2, []), (3, None)], "request_id long, texts array<string>")
    got = {r["request_id"]: [p["prediction_name"] for p in r["predictions"]] for r in model.score_batches(asked, fitted).collect()}
    assert got == {1: ["Hate Speech", "Safe"], 2: [], 3: []}


def test_keyed_json_in_byte_ranges(spark, tmp_path):
    """One object, pretty or not, read by many tasks: entries with commas, braces, quotes and line breaks inside strings."""
    def post(i):
        return {"post_tokens": [f"w{i}", "a, b", '{"x": [1, 2]}', 'say \\"hi\\", ok', "}]", "\\", "line\nbreak, é"], "annotators": [{"label": f"l, {i % 3}"}], "rationales": []}

    want = {}
    for name, ids, indent in (("a", range(0, 60), None), ("b", range(100, 160), 2), ("c", range(200, 201), None), ("d", range(0), None)):
        posts = {f"id,{i}": post(i) for i in ids}
        (tmp_path / f"{name}.json").write_text(json.dumps(posts, indent=indent, ensure_ascii=name == "b"), encoding="utf-8")
        want |= {k: (v["post_tokens"], v["annotators"][0]["label"]) for k, v in posts.items()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97", "700", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = readers.read_annotated(spark, str(tmp_path)).collect()
            assert len(rows) == len(want) and {r["post_id"]: (r["post_tokens"], r["annotators"][0]["label"]) for r in rows} == want, size
            tasks = spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
            assert size != "97" or tasks > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_annotated_lines(spark, tmp_path):
    lines = [json.dumps({"post_id": "p1", "post_tokens": ["a", "b"], "annotators": [{"label": "x"}]}),
             json.dumps({"p2": {"post_tokens": ["c"], "annotators": [{"label": "y"}]}, "p3": {"post_tokens": [], "annotators": []}}), "", "{}"]
    (tmp_path / "posts.jsonl").write_text("\n".join(lines))
    got = {r["post_id"]: r["post_tokens"] for r in readers.read_annotated_lines(spark, str(tmp_path)).collect()}
    assert got == {"p1": ["a", "b"], "p2": ["c"], "p3": []}


def test_first_rows_far_keys(spark):
    """Keys that lie far off do not bring all other rows into one bucket; both ends of the 64-bit range are keys like others."""
    ids = [*range(5000), -(2**63), 2**63 - 1, 2**40]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "row_id long")
    for n in (0, 1, 2, 700, 5000, 5001, 5002, 5003, 9000):
        got = sorted(r[0] for r in readers.first_rows(df, n, ranked=50).collect())
        assert got == sorted(ids)[:n], n
    assert readers.first_rows(df.limit(0), 3).count() == 0


def test_sent_names_enter_the_plan_once(spark, monkeypatch):
    texts = ["O'Neil Smith met Mary Stone.", "back\\slash Mary", "Lone", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    known = ["Mary", "O'Neil", "Lone"] + [f"Name{i}" for i in range(300)]
    made, column = [], type(F.col("x"))
    real = column.isin
    monkeypatch.setattr(column, "isin", lambda self, *xs: made.extend(xs) or real(self, *xs))
    got = {r["row_id"]: r["text"] for r in names.mask_names_by(df, spark.createDataFrame([(n,) for n in known], "name string")).collect()}
    assert got == {0: "someone someone met someone someone .", 1: "back \\ slash someone", 2: "someone", 3: None, 4: ""}
    assert len(made) < 50


def test_names_found_are_marked_by_a_set(spark):
    texts = ["Mary Mary Smith Jones", "x  Mary's Mary's\tMary\nÉlan Bo", "\x00 Mary \x01 Ann", "Mary", " ", None, "Peter-Paul Ann", "MARY Ann"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    lexicon = spark.createDataFrame([("Mary",), ("Peter",), ("two words",), ("x",), ("",)], "name string")
    sent, joined = ({r["row_id"]: r["text"] for r in names.mask_names_by(df, lexicon.where("name <> ''"), sent=n).collect()} for n in (100, 0))
    assert joined == sent and joined[0] == "someone someone someone Jones" and joined[1] == "someone Mary's Mary's someone someone Bo"
    plan = names.mask_names_by(df, lexicon, sent=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan


def test_training_writes_the_counts_of_words_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, ("good day", "bad night", "evil word")[i % 3], i % 3) for i in range(30)], "row_id long, text string, label int")
    made, real = [], model.materialize
    monkeypatch.setattr(model, "materialize", lambda df, name: made.append(df.columns) or real(df, name))
    ready = materialize(model.prepare_for_scoring(rows), "ready")
    fitted = model.train(ready, model.Hyperparameters(max_iter=5, buckets=256))
    assert made == [["label", "counts", "weight"]] and len(fitted.stages) == 4
    assert model.score(ready, fitted, prepared=True).filter("label = predicted_label").count() == 30
    parts = [sorted(map(tuple, model.token_importance(df, fitted, prepared=p).collect())) for df, p in ((rows, False), (ready, True))]
    assert parts[0] == parts[1] and len(parts[0]) == 60
