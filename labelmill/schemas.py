"""Explicit schemas of the raw sources and of the derived tables."""

from pyspark.sql import types as T

SRC_CODE = T.StructType([T.StructField("tweet", T.StringType()), T.StructField("class", T.IntegerType())])

SRC_BINARY = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])

ANNOTATED_POST = T.StructType(
    [
        T.StructField("post_tokens", T.ArrayType(T.StringType())),
        T.StructField("annotators", T.ArrayType(T.StructType([T.StructField("label", T.StringType())]))),
    ]
)
SRC_ANNOTATED_MAP = T.MapType(T.StringType(), ANNOTATED_POST)
SRC_ANNOTATED = T.StructType([T.StructField("post_id", T.StringType()), *ANNOTATED_POST.fields])

FLAG_COLUMNS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
SRC_FLAGS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in FLAG_COLUMNS]
)

SCORE_COLUMNS = (
    "toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit",
)
SRC_SCORES = T.StructType(
    [T.StructField("text", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in SCORE_COLUMNS]
)

UNIFIED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("duration_ms", T.DoubleType()),
    ]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("text_length", T.IntegerType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("processing_time_ms", T.DoubleType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField(
            "probabilities",
            T.StructType(
                [
                    T.StructField("Safe", T.DoubleType()),
                    T.StructField("Offensive", T.DoubleType()),
                    T.StructField("Hate Speech", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("processing_time_ms", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
