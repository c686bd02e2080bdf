"""Columns of struct type whose fields have odd names pass through the operators."""

from pyspark.sql import functions as F

from labelmill.llm import html_text, quality, substring_dedup


def test_struct_columns(spark):
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some text of the house and the river").alias("text"), F.lit("en").alias("lang"),
                                 F.lit("<p>x</p>").alias("html"), F.struct(F.lit(1).alias("a b"), F.array(F.struct(F.lit("x").alias("c`d"))).alias("e-f")).alias("odd one"))
    for made in (html_text.extract_main_text(rows), quality.judge_quality(rows), substring_dedup.drop_repeated_substrings(rows)):
        assert made.count() == 3 and made.schema["odd one"].dataType.simpleString() == rows.schema["odd one"].dataType.simpleString()
        assert made.first()["odd one"]["a b"] == 1
