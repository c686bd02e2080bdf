"""Language by function words (inside the row, no shuffle), or by letter trigrams learnt from labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.storage import materialize

# Frequent function words per language; ties go to the language listed first.
PROFILES = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are",
           "be", "this", "you", "not", "have", "at"),
    "fr": ("le", "la", "les", "des", "et", "une", "du", "que", "dans", "qui", "pour", "pas", "au", "sur",
           "est", "avec", "elle", "ne", "ce", "aux"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "ist", "nicht", "ein",
           "eine", "dem", "auch", "für", "als", "wird", "im"),
    "es": ("el", "los", "las", "una", "del", "que", "y", "por", "con", "para", "como", "más", "pero", "sus",
           "se", "lo", "fue", "este", "ha", "ser"),
}


def language_votes(text: Column, profiles: dict = PROFILES) -> Column:
    """``array<struct<n, rank, lang>>``: how many words (runs of letters and digits) are in each profile."""
    known = sorted({w for vocabulary in profiles.values() for w in vocabulary})
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*known))

    def tally(found):
        def hits(vocabulary):
            return F.size(F.filter(found, lambda w: w.isin(*vocabulary)))

        return F.array(
            *[
                F.struct(hits(vocabulary).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
                for i, (lang, vocabulary) in enumerate(profiles.items())
            ]
        )

    return tx.bind(tokens, tally)


def detected_language(text: Column, ascii_shortcut: bool = True, profiles: dict = PROFILES) -> Column:
    """Blank text is ``unknown``; pure ASCII is taken for English if ``ascii_shortcut``; else the vote."""
    best = F.array_max(language_votes(text, profiles))
    vote = tx.bind(best, lambda b: F.when(b["n"] > 0, b["lang"]).otherwise("unknown"))
    lang = F.when(text.isNull() | tx.is_blank(text), "unknown")
    if ascii_shortcut:
        lang = lang.when(~text.rlike(r"[^\x00-\x7F]"), "en")
    return lang.otherwise(vote)


def filter_language(df: DataFrame, text: str, wanted: str, ascii_shortcut: bool = True) -> DataFrame:
    """Drop a row only if its language is known and not the wanted one."""
    return df.filter(detected_language(F.col(text), ascii_shortcut).isin(wanted, "unknown"))


# Scripts that settle the question without any profile.
SCRIPTS = {
    "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}",
    "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}",
}
GRAM_SHARE = 2000  # a trigram counts if it makes up one in so many of a language's: at most so many for each language
COMMON_WORDS, COMMON_LENGTH = 20_000, 64  # words whose weights are added up beforehand, and their most characters
UNKNOWN = "unknown"


def foreign_script(text: Column) -> Column:
    """The script most letters of a text are in, if that is not the Latin one; else null. Ties go to the Latin one, then to the script listed first."""
    def judged(rest: Column) -> Column:  # the scripts have no ASCII letter, so they are looked for in what is left without ASCII
        counts = F.array(*[F.struct(F.regexp_count(rest, F.lit(p)).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("script"))
                           for i, (name, p) in enumerate(SCRIPTS.items())])
        latin = F.regexp_count(text, F.lit(r"\p{IsLatin}"))
        return tx.bind(F.array_max(counts), lambda best: F.when((best["n"] > 0) & (best["n"] > latin), best["script"]))

    return tx.bind(F.regexp_replace(text, r"[\x00-\x7F]+", ""), lambda rest: F.when(rest != "", judged(rest)))


def letter_words(text: Column) -> Column:
    """The lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_trigrams(word: Column) -> Column:
    """Trigrams of a word with a mark at both ends, as many as it has letters."""
    marked = F.concat(F.lit("_"), word, F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(marked, i, F.lit(3)))


def trigrams(text: Column) -> Column:
    """Trigrams of the lower-cased runs of letters, with a mark at both ends of a run."""
    return F.flatten(F.transform(letter_words(text), word_trigrams))


class GramProfiles:
    """Weights of trigrams: ``table (gram, <one column for each of langs>)``, whole thousandths of a logarithm.

    A weight is ``ln((n + 0.5) / (N + 0.5 * V))``: ``n`` times the gram among the ``N`` of the language, ``V`` grams in the table.
    ``words (word, known, <one column for each of langs>)``, if given, has the number of known trigrams of some common words and the sums
    of their weights, which only saves work.
    """

    def __init__(self, table: DataFrame, langs: list[str], words: DataFrame | None = None):
        self.table, self.langs, self.words = table, langs, words


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", share: int = GRAM_SHARE) -> GramProfiles:
    """Profiles of the languages of ``df``. Rows without a language or a text teach nothing.

    Words are counted first, so each distinct word is spelled out once for each language and not at each place.
    """
    words = (df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    words = materialize(words, "words")
    counts = words.select("lang", "n", F.explode(word_trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # one row for each language
    langs = sorted(totals)
    total = F.create_map(*[F.lit(x) for name in langs for x in (name, totals[name])]) if langs else F.create_map().cast("map<string,bigint>")
    vocabulary = counts.filter(F.col("n") * share >= total[F.col("lang")]).select("gram").distinct()
    held = counts.join(F.broadcast(vocabulary), "gram")  # at most `share` grams for each language
    wide = materialize(held.groupBy("gram").agg(F.count(F.lit(1)).alias("langs"), *[F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(langs)]), "profiles")
    size = wide.count()
    weights = [F.round(1000 * F.log((F.col(f"n{i}") + 0.5) / (totals[name] + 0.5 * size))).cast("long").alias(f"w{i}") for i, name in enumerate(langs)]
    table = wide.select("gram", *weights)
    common = (words.filter(F.length("word") <= COMMON_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word"))
    spelled = common.select("word", F.explode(word_trigrams(F.col("word"))).alias("gram")).join(F.broadcast(table), "gram", "left")
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(langs))]
    return GramProfiles(table, langs, materialize(spelled.groupBy("word").agg(F.count("w0").alias("known"), *sums), "common") if langs else None)


def detect_language(df: DataFrame, profiles: GramProfiles, text: str = "text", key: str = "row_id") -> DataFrame:
    """``(key, detected)`` for each ``key``: the script if it is not Latin, else the language under which the trigrams are likeliest.

    Ties go to the language first in the alphabet; texts without a known trigram, null and empty ones are ``unknown``.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    latin = rows.filter(foreign_script(F.col("_text")).isNull())
    n = range(len(profiles.langs))
    if profiles.words is None:
        grams = latin.select("_key", F.explode(trigrams(F.col("_text"))).alias("gram"))
        sums = grams.join(F.broadcast(profiles.table), "gram").groupBy("_key").agg(F.count(F.lit(1)), *[F.sum(f"w{i}").alias(f"w{i}") for i in n])
    else:  # common words bring their sums, only the others are spelled out
        sent = F.broadcast(profiles.words.select("word", "known", *[F.col(f"w{i}").alias(f"c{i}") for i in n]))
        words = latin.select("_key", F.explode(letter_words(F.col("_text"))).alias("word")).join(sent, "word", "left")
        spelled = F.when(F.col("known").isNull(), word_trigrams(F.col("word"))).otherwise(F.array(F.lit(None).cast("string")))
        grams = words.select("_key", "known", *[f"c{i}" for i in n], F.explode(spelled).alias("gram")).join(F.broadcast(profiles.table), "gram", "left")
        sums = (grams.groupBy("_key").agg(F.sum(F.coalesce("known", F.col("w0").isNotNull().cast("long"))).alias("known"),
                                          *[F.sum(F.coalesce(f"c{i}", f"w{i}")).alias(f"w{i}") for i in n]).filter("known > 0"))
    each = F.array(*[F.struct(F.col(f"w{i}").alias("w"), F.lit(-i).alias("rank"), F.lit(name).alias("lang")) for i, name in enumerate(profiles.langs)])
    best = sums.select("_key", F.array_max(each)["lang"].alias("_best")) if profiles.langs else sums.select("_key", F.lit(None).cast("string").alias("_best"))
    named = rows.select("_key", foreign_script(F.col("_text")).alias("_script")).join(best, "_key", "left")
    return named.select(F.col("_key").alias(key), F.coalesce("_script", "_best", F.lit(UNKNOWN)).alias("detected"))


def keep_language(df: DataFrame, profiles: GramProfiles, wanted: str, text: str = "text", key: str = "row_id") -> DataFrame:
    """Drop a row only if its language or script is known and not the wanted one. ``key`` is unique."""
    other = detect_language(df, profiles, text, key).filter(~F.col("detected").isin(wanted, UNKNOWN)).select(key)
    return df.join(other, key, "left_anti")
