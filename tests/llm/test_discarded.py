"""Tables of an operator that nothing reads any more are deleted."""

import os

from pyspark.sql import functions as F

from labelmill import storage
from labelmill.llm import language_model


def test_blocks_of_the_model_go_when_they_are_counted(spark, monkeypatch):
    written, write = {}, language_model.materialize

    def kept(df, name):
        written[name] = out = write(df, name)
        written[name, "files"] = [f.removeprefix("file://") for f in out.inputFiles()]
        return out

    monkeypatch.setattr(language_model, "materialize", kept)
    docs = spark.createDataFrame([(i, f"a b c{i % 5} d") for i in range(30)], "doc_id long, text string").repartition(3)
    scored = language_model.score_texts(docs)
    assert scored.count() == 30
    assert not any(os.path.exists(f) for f in written["lm-blocks", "files"])
    assert all(os.path.exists(f) for name in ("lm-words", "lm-counted", "lm-arcs", "lm-fail") for f in written[name, "files"])


def test_discard_deletes_only_own_tables(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    storage.discard(spark.read.parquet(str(tmp_path / "t")))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    one, two = (storage.materialize(spark.range(n), "same") for n in (3, 4))
    storage.discard(one)
    assert two.count() == 4 and one.inputFiles()
    storage.discard(storage.materialize(spark.range(3).where(F.lit(False)), "none"))
