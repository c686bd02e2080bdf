"""Quality rules: counts of a text, and its divergence from the way its language is usually written.

One pass over the texts gives counts and two histograms for each document: characters by class, and frequent function
words. The histograms of all documents of a language add up to its reference. A document whose Jensen-Shannon distance from
the reference is too large is rejected; short texts are too noisy for that and are only judged by the base rules. Texts that hardly
use function words go as well, in languages that do: what counts is the distance between the shares of function words as a
part of the largest such distance, that of a text without any. Tables (cells between bars) need no function words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.bytesops import hash_words, shingles
from labelmill.llm.common import Carried, materialize, quoted, whole

# Frequent function words of the languages at hand; what counts is how often each language uses them, learnt from the corpus.
COMMON_WORDS = tuple(
    "the of and to in a is that it for on was be with as by this are from at or an not have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et des un une du en que est dans pour pas sur au avec ce plus "
    "el los las y por con para una su al lo como más se no del".split())
CLASSES = ("lower", "upper", "digit", "white", "sentence", "symbol", "beyond_ascii")
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
MAX_ABSENCE = 0.80  # of the distance of a text without function words; about a tenth of the language's share
LEAST_SHARE = 0.10  # a language whose texts use the listed words less is not listed, and lacks none
TABLE_BARS = 0.10   # bars for each word from which a text is a table
LEAST_WORDS = 50    # below: base rules only
LEAST_CHARS = 200

_CLASS = np.full(256, 6, np.int64)
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:192] = 7  # continues a character
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _word_table(words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words as written small, with a capital and in capitals, and the word each stands for."""
    names = list(dict.fromkeys(words))
    hashes = {int(hash_words(form.encode())[0]): i for i, w in enumerate(names) for form in (w, w.capitalize(), w.upper())}
    keys = np.array(sorted(hashes), np.uint64)
    return keys, np.array([hashes[int(k)] for k in keys])


def text_counts(text: str | None, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """Base counts, characters by class, function words (the last place: all other words), and bars."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    classes = np.bincount(_CLASS[data], minlength=8)[:7]
    words = hash_words(raw)
    n = len(words)
    repeated = 0
    if n > 3:
        _, inverse, counts = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    keys, owner = table
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    known = keys[at] == words
    size = int(owner.max()) + 1
    hist = np.append(np.bincount(owner[at[known]], minlength=size), n - int(known.sum()))
    return [n, int(classes.sum() - classes[3]), int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated], classes, hist, int((data == ord("|")).sum())


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(words: tuple[str, ...]):
    fields = [pa.field("_row", pa.int64()), *[pa.field(c, pa.int64()) for c in BASE_COUNTS], pa.field("_classes", pa.list_(pa.int64())), pa.field("_common", pa.list_(pa.int64())), pa.field("_bars", pa.int64())]

    def run(batches):
        table = _word_table(words)
        for batch in batches:
            rows = [text_counts(t.as_py(), table) for t in batch.column("_text")]
            made = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(BASE_COUNTS))]
            lists = [pa.array([r[i].tolist() for r in rows], pa.list_(pa.int64())) for i in (1, 2)]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            names = [name for name in batch.schema.names if name != "_text"]
            yield pa.record_batch([*kept, *made, *lists, pa.array([r[3] for r in rows], pa.int64())], names=[*names, *[f.name for f in fields[1:]]])

    return run


def shannon_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, in 0 to 1, of two histograms given as shares."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: 0.5 * (part(a, (a + b) / 2) + part(b, (a + b) / 2)))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def shares(hist: Column) -> Column:
    """A histogram as shares; empty ones stay all 0."""
    total = F.greatest(F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    return F.transform(F.arrays_zip(hist.alias("x"), F.array_repeat(total, F.size(hist)).alias("t")), lambda r: r["x"] / r["t"])


def judge_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE,
                  max_word: float = MAX_WORD_DISTANCE, words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """``docs`` with base counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    Base rules: fewer than 50 words, or more than half of the words in 3-word windows found twice or more in the text. Texts of
    50 words and 200 characters or more are also rejected when one of their distances from the reference of their language is
    too large, or when their share of function words is as far from the language's as ``MAX_ABSENCE`` of what a text without any is;
    tables and languages that use few of the listed words are spared that. Null language: a language of its own. Null or empty text: no words, so rejected. Repeated rows are judged
    each. No rows: no rows. Columns with the names of the results are replaced.
    """
    rest = Carried(docs, *BASE_COUNTS, "class_distance", "word_distance", "base_failed", "kept")
    held = [f"_in{i}" for i in range(len(rest.names))]
    plain = docs.select(*rest.cols, F.col(quoted(lang_col)).alias("_lang"), whole(text_col).alias("_text"))
    lang = plain.schema["_lang"].dataType.simpleString()
    ddl = ", ".join([*([rest.fields] if held else []), f"_lang {lang}", *[f"{c} bigint" for c in BASE_COUNTS], "_classes array<bigint>, _common array<bigint>, _bars bigint"])
    counted = materialize(plain.mapInArrow(_measure(words), ddl), "quality-counts")
    n_words = len(dict.fromkeys(words)) + 1
    adding = lambda col, n: F.array(*[F.sum(F.col(col)[i]) for i in range(n)])
    refs = counted.groupBy("_lang").agg(adding("_classes", len(CLASSES)).alias("c"), adding("_common", n_words).alias("w"))
    refs = refs.select(F.col("_lang").alias("_ref"), shares(F.col("c")).alias("_ref_classes"), shares(F.col("w")).alias("_ref_common"))
    rows = counted.select(*held, *BASE_COUNTS, "_bars", "_lang", F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x).alias("_chars"),
                          shares(F.col("_classes")).alias("_c"), shares(F.col("_common")).alias("_w"))
    joined = rows.join(refs, F.col("_lang").eqNullSafe(F.col("_ref")))
    two = lambda h: F.array(1 - F.element_at(h, -1), F.element_at(h, -1))  # noqa: E731 - listed words and others
    absent = shannon_distance(two(F.col("_w")), two(F.col("_ref_common"))) > MAX_ABSENCE * shannon_distance(F.array(F.lit(0.0), F.lit(1.0)), two(F.col("_ref_common")))
    few = (F.element_at("_w", -1) > F.element_at("_ref_common", -1)) & (1 - F.element_at("_ref_common", -1) >= LEAST_SHARE) & (F.col("_bars") < TABLE_BARS * F.col("n_words"))
    measured = joined.select(*rest.back(), *BASE_COUNTS, "_chars", (few & absent).alias("_absent"), shannon_distance(F.col("_c"), F.col("_ref_classes")).alias("class_distance"),
                             shannon_distance(F.col("_w"), F.col("_ref_common")).alias("word_distance"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    strange = (F.col("_chars") >= LEAST_CHARS) & ((F.col("class_distance") > max_class) | (F.col("word_distance") > max_word) | F.col("_absent"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~(failed | strange)).drop("_chars", "_absent")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with their columns."""
    held = docs.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(quoted(text_col)).alias("_t"), F.col(quoted(lang_col)).alias("_l"))
    judged = judge_quality(held, "_t", "_l", **options)
    return judged.where("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
