"""Softmax and argmax on arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value; the first of equals wins."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def percent(p: Column) -> Column:
    return F.round(p * 100, 2)
