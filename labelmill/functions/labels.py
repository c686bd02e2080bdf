"""Label rules as column expressions; classes are ordered by severity (0 < 1 < 2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.config import LABEL_NAMES

# Label codes of the corpora and the class each stands for.
LABEL_MAPPING = {
    "davidson": {"0": ("hate speech", 2), "1": ("offensive language", 1), "2": ("neither", 0)},
    "olid": {"0": ("non-offensive", 0), "1": ("offensive", 1)},
    "hatexplain": {"normal": ("Safe", 0), "offensive": ("Offensive", 1), "hatespeech": ("Hate Speech", 2)},
}
CODE_MAP = {0: 2, 1: 1, 2: 0}
BINARY_MAP = {0: 0, 1: 1}
VOTE_MAP = {"normal": 0, "offensive": 1, "hatespeech": 2}


def map_code(code: Column, mapping: dict) -> Column:
    """Look a code up in a small fixed mapping; unknown codes give null."""
    return reduce(lambda acc, kv: acc.when(code == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F).cast("int")


def binary_nonzero(code: Column) -> Column:
    """Older reading of the binary corpus: whatever is not 0 is offensive."""
    return F.when(code == 0, 0).otherwise(1)


def any_flag(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f == 1, F.lit(False)) for f in flags])


def flag_severity(severe: list[Column], mild: list[Column]) -> Column:
    """2 if any severe flag is set, else 1 if any mild one is, else 0."""
    return F.when(any_flag(severe), 2).when(any_flag(mild), 1).otherwise(0)


def score_severity(severe: list[Column], mild: list[Column], threshold: float = 0.5) -> Column:
    """The same on fractional scores; a missing score counts as 0."""

    def reaches(scores):
        return reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(0.0)) >= threshold for s in scores])

    return F.when(reaches(severe), 2).when(reaches(mild), 1).otherwise(0)


def label_name(label: Column) -> Column:
    """Class name; unknown classes read ``Class k``."""
    known = reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), LABEL_NAMES.items(), F)
    return known.otherwise(F.concat(F.lit("Class "), label.cast("string")))


def vote_in_row(votes: Column, mapping: dict = VOTE_MAP, ties: str = "severity") -> Column:
    """Majority of an array of annotator labels without leaving the row.

    Equal counts go to the most severe class (``ties="severity"``) or to the label named first
    (``ties="first_seen"``). Labels outside the mapping count as votes and end up as class 0.
    """
    def tally(v):
        severity = F.coalesce(map_code(v, mapping), F.lit(0))
        count = F.size(F.filter(votes, lambda x: x.eqNullSafe(v)))
        rank = severity if ties == "severity" else -F.array_position(votes, v).cast("int")
        return F.struct(count.alias("count"), rank.alias("rank"), severity.alias("severity"))

    ballots = F.transform(F.array_distinct(votes), tally)
    return F.when(F.size(votes) > 0, F.array_max(ballots)["severity"])
