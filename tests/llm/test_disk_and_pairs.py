"""Shuffle files of written tables go, texts of the mix are shuffled once, and candidates of near-dedup don't grow with the square."""

import random
import time

from pyspark.sql import functions as F

from labelmill import storage
from labelmill.llm import mixing, near_dedup
from tests.llm.test_near_blocks import labels
from tests.llm.test_operators import link


def test_shuffle_files_go_when_a_table_is_written(spark):
    spark.conf.set(storage.SHUFFLE_CLEANUP, "false")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = manager.getAllFiles()
        return {f for f in (every.apply(i).getName() for i in range(every.size())) if f.startswith("shuffle_")}

    before = files()
    table = storage.materialize(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "test")
    end = time.time() + 10
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(storage.SHUFFLE_CLEANUP) == "false" and table.count() == 7
    spark.conf.unset(storage.SHUFFLE_CLEANUP)
    storage.materialize(spark.range(1), "test")
    assert spark.conf.get(storage.SHUFFLE_CLEANUP, None) is None


def test_texts_of_the_mix_are_shuffled_once(spark):
    rows = [(i, f"word{i} and more", s) for i in range(40) for s in ("a", "b", None)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string"),
                 spark.createDataFrame([(i, t, s or "c") for i, t, s in rows], "doc_id long, text string, source string not null")):
        docs = docs.union(docs.limit(5))
        taken = mixing.take(docs)
        assert "cast(_mine" not in taken._jdf.queryExecution().executedPlan().toString()
        assert taken.agg(F.sum("taken")).first() == mixing.mix(docs).agg(F.sum("taken")).first()


def test_candidates_do_not_grow_with_the_square(spark, monkeypatch):
    """Short texts over a few common words: any two share words, hardly any are similar."""
    monkeypatch.setattr(near_dedup, "FAMILY", 8)
    monkeypatch.setattr(near_dedup, "FAMILIES", 1)
    monkeypatch.setattr(near_dedup, "WIDE_SETS", 50, raising=False)
    seen, write = {}, near_dedup.materialize

    def counted(df, name):
        out = write(df, name)
        if {"a", "b"} <= set(out.columns) or {"g", "h"} <= set(out.columns):
            seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    rng = random.Random(5)
    texts = {i: " ".join(rng.sample([f"w{j}" for j in range(60)], rng.choice([16, 20]))) for i in range(240)}
    for i in range(20):
        texts[1000 + i] = texts[i] + f" x{i}"
    assert labels(spark, texts, width=1) == link(texts, 1, 80)
    assert max(seen.values()) <= 5 * len(texts), seen
