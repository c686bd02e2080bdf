"""Learnt language profiles: held-out accuracy, scripts, and texts that settle nothing."""

from pyspark.sql import functions as F

from labelmill.operators import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", "lang")
    profiles = language.learn_profiles(docs.where("row_id % 2 = 0"))
    assert profiles.langs == ["de", "en", "es", "fr"]
    assert profiles.table.count() <= language.GRAM_SHARE * len(profiles.langs)
    held_out = docs.where("row_id % 2 = 1 AND length(text) >= 200")
    found = held_out.join(language.detect_language(held_out, profiles), "row_id")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("detected")), F.count("*")).first()
    assert total > 300 and right / total > 0.9


def test_scripts_and_unknown(spark):
    teach = spark.createDataFrame([("the house of the river and the stone", "en"), ("la maison de la rivière et les pierres", "fr"), (None, "en"), ("ohne", None)], "text string, lang string")
    profiles = language.learn_profiles(teach)
    texts = ["the stone house", "les maisons", "Привет, мир! ok", "مرحبا بالعالم", "你好 世界", "안녕하세요", "Γειά σου", None, "", " \n", "123 ++", "ab Привет", "ЖЖ zz", "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    found = [r["detected"] for r in language.detect_language(rows, profiles).orderBy("row_id").collect()]
    assert found[:7] == ["en", "fr", "cyrillic", "arabic", "cjk", "hangul", "greek"]
    assert found[7:11] == ["unknown"] * 4 and found[11] == "cyrillic" and found[13] == "unknown"
    kept = {r["row_id"] for r in language.keep_language(rows, profiles, "en").collect()}
    assert kept == {i for i, f in enumerate(found) if f in ("en", "unknown")}


def test_nothing_learnt(spark):
    none = spark.createDataFrame([], "row_id long, text string, lang string")
    profiles = language.learn_profiles(none)
    assert profiles.langs == [] and language.detect_language(none, profiles).count() == 0
    rows = spark.createDataFrame([(1, "some text"), (2, "мир")], "row_id long, text string")
    assert {r["row_id"]: r["detected"] for r in language.detect_language(rows, profiles).collect()} == {1: "unknown", 2: "cyrillic"}


def test_common_words_bring_the_sums_of_their_trigrams(spark, monkeypatch):
    """Words that are not among the common ones are spelled out; both ways give the same sums."""
    teach = spark.createDataFrame([("the house of the river the stone", "en"), ("la maison de la rivière", "fr"), ("der stein im haus", "de")], "text string, lang string")
    monkeypatch.setattr(language, "COMMON_WORDS", 2)
    profiles = language.learn_profiles(teach)
    words = {r["word"]: r for r in profiles.words.collect()}
    assert set(words) == {"the", "la"} and words["the"]["known"] == 3
    weights = {r["gram"]: r["w1"] for r in profiles.table.collect()}
    assert words["the"]["w1"] == sum(weights[g] for g in ("_th", "the", "he_"))
    rows = spark.createDataFrame(list(enumerate(["the river", "la pierre", "xyz 12", "", None, "the", "der la the", "haus haus"])), "row_id long, text string")
    told = [sorted(map(tuple, language.detect_language(rows, p).collect())) for p in (profiles, language.GramProfiles(profiles.table, profiles.langs))]
    assert told[0] == told[1] and len(told[0]) == 8


def test_scripts_are_looked_for_behind_ascii(one):
    texts = ("plain", "é à", "Привет, мир! ok", "ab Жz", "ЖЖ zz", "", None, "\U0001f600 x")
    assert one(language.foreign_script, *texts) == [None, None, "cyrillic", None, None, None, None, None]
    assert "regexp_replace" in str(language.foreign_script(F.col("t")))
