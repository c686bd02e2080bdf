"""Masking of person names: a title-case token found in a given-name list becomes ``someone``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.functions import unicode as un

MASK = "someone"

GIVEN_NAMES = (
    "Adam", "Alice", "Amanda", "Amy", "Andrea", "Andrew", "Angela", "Anna", "Anthony", "Ashley", "Barbara",
    "Benjamin", "Brandon", "Brian", "Carol", "Charles", "Christine", "Christopher", "Daniel", "David",
    "Deborah", "Dennis", "Donald", "Dorothy", "Edward", "Elizabeth", "Emily", "Emma", "Eric", "Frank",
    "Gary", "George", "Gregory", "Hannah", "Heather", "Helen", "Henry", "Jacob", "James", "Janet", "Jason",
    "Jeffrey", "Jennifer", "Jessica", "John", "Jonathan", "Joseph", "Joshua", "Julia", "Karen", "Katherine",
    "Kenneth", "Kevin", "Kimberly", "Larry", "Laura", "Linda", "Lisa", "Margaret", "Maria", "Mary",
    "Matthew", "Melissa", "Michael", "Michelle", "Nancy", "Nicholas", "Nicole", "Olivia", "Pamela",
    "Patricia", "Patrick", "Paul", "Peter", "Rachel", "Rebecca", "Richard", "Robert", "Ronald", "Ruth",
    "Ryan", "Samantha", "Samuel", "Sandra", "Sarah", "Scott", "Sharon", "Stephanie", "Stephen", "Steven",
    "Susan", "Teresa", "Thomas", "Timothy", "Victoria", "Virginia", "William",
)


def word_tokens(text: Column) -> Column:
    """Words and punctuation marks as separate tokens."""
    return tx.words(F.regexp_replace(text, r"([^\p{L}\p{N}_\s'])", " $1 "))


def is_title(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}\p{Ll}+$")


def mask_names(text: Column, names=GIVEN_NAMES) -> Column:
    """Mask listed names and the title-case word that follows one; tokens are rejoined by blanks."""

    def masked(token, before):
        surname = F.coalesce(before.isin(*names), F.lit(False)) & is_title(token)
        return F.when(token.isin(*names) | surname, MASK).otherwise(token)

    def sentence(tokens):
        # each token next to the one before it; the pair past the end has no token and is skipped
        pairs = F.zip_with(tokens, F.concat(F.array(F.lit("")), tokens), masked)
        # most texts hold no listed name, then no token changes
        named = F.lit(True) if "" in names else F.exists(tokens, lambda t: t.isin(*names))
        return F.array_join(F.when(named, F.slice(pairs, 1, F.size(tokens))).otherwise(tokens), " ")

    return tx.bind(word_tokens(text), sentence)


NAMES_SENT = 20_000  # names that may become part of the plan


def _mask_sent(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``mask_names`` with many names: they enter the plan once, as one text, and not by a call for each."""
    plain = [n for n in names if not set(n) & set("'\\$")]
    listed = "transform(_tokens, w -> w IN (" + ", ".join(f"'{n}'" for n in plain) + "))" if plain else "transform(_tokens, w -> false)"
    odd = [n for n in names if set(n) & set("'\\$")]  # what these mean in an SQL text depends on settings
    rows = df.withColumn("_tokens", word_tokens(F.col(text))).withColumn("_listed", F.expr(listed))
    if odd:
        rows = rows.withColumn("_listed", F.zip_with("_listed", "_tokens", lambda known, t: known | t.isin(*odd)))
    told = F.zip_with("_tokens", "_listed", lambda t, known: F.struct(t.alias("token"), known.alias("known")))
    start = F.array(F.struct(F.lit("").alias("token"), F.lit("" in names).alias("known")))

    def masked(one, before):
        return F.when(one["known"] | (before["known"] & is_title(one["token"])), MASK).otherwise(one["token"])

    def sentence(pairs):
        return F.array_join(F.slice(F.zip_with(pairs, F.concat(start, pairs), masked), 1, F.size(pairs)), " ")

    return rows.withColumn(text, tx.bind(told, sentence)).drop("_tokens", "_listed")


def mask_names_by(df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "row_id", name: str = "name",
                  sent: int = NAMES_SENT) -> DataFrame:
    """``mask_names`` with the names of a table; null names name nobody. ``id_col`` is unique.

    A lexicon of up to ``sent`` names goes into the plan, which then needs no shuffle. With a larger one the distinct words of each
    text meet it by a join, and only the names found come back to the row.
    """
    known = lexicon.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    head = known.limit(sent + 1).collect()  # at most one more than may be sent
    if len(head) <= sent:
        return _mask_sent(df, text, [r["_name"] for r in head])
    each = df.select(id_col, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("_name"))
    found = each.join(known, "_name").groupBy(id_col).agg(F.collect_set("_name").alias("_found"))
    rows = df.join(found, id_col, "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    # Tokens hold no white space: each stands between two blanks of its own, and a tab marks those found. Spark would look each token
    # up in the whole array of names found, so that is done by a set in Python.
    rows = rows.withColumn("_tokens", word_tokens(F.col(text)))
    marked = F.concat(F.lit(" "), un.mark_listed(F.col("_tokens"), F.col("_found")), F.lit(" "))
    surnames = F.regexp_replace(marked, r"(\t[^ ]+  )\p{Lu}\p{Ll}+ ", f"$1{MASK} ")
    masked = F.trim(F.replace(F.regexp_replace(surnames, r"\t[^ ]+", MASK), F.lit("  "), F.lit(" ")))
    return rows.withColumn(text, masked).select(*df.columns)
