"""Text cleaning steps as JVM column expressions (no Python in the row path).

Java's character classes are ASCII-only unless told otherwise, so the patterns
here spell out the Unicode classes: ``WORD`` is a letter, digit or underscore in any
script, ``SPACE`` is any white space including the four separator controls.
``(?d)`` makes ``.`` stop at ``\\n`` only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"[\p{L}\p{N}_]"

# The same white space as characters.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------- basics


def where_found(c: Column, marks: tuple[str, ...], changed: Column) -> Column:
    """``changed`` for texts that hold one of the marks, else the text itself.

    A byte search costs a fraction of a pattern search, and most texts lack most marks.
    """
    found = reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])
    return F.when(found, changed).otherwise(c)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` mentions it."""
    return F.transform(F.array(value), fn)[0]


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (Spark's ``trim`` knows only the blank)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def words(c: Column) -> Column:
    """White-space separated words; blank text has none."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_blank(c: Column) -> Column:
    """True for white space only; null stays null."""
    return ~c.rlike(f"[^{SPACE}]")


def guard_blank(c: Column) -> Column:
    """Null or blank text becomes the empty text."""
    return F.when(c.isNull() | is_blank(c), F.lit("")).otherwise(c)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def canonical(c: Column) -> Column:
    """Key under which two texts count as equal: case-folded and stripped."""
    return strip(F.lower(c))


def fingerprint(c: Column) -> Column:
    """256-bit digest that stands in for a long text as a grouping key, so shuffles stay small."""
    return F.sha2(c, 256)


def squeeze_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def lower(c: Column) -> Column:
    return F.lower(c)


# ---------------------------------------------------------------- mark-up


def strip_tags(c: Column, always: bool = False) -> Column:
    """Drop comments, scripts, styles and tags but keep the text between tags.

    A ``<`` counts as a tag only before a letter, ``/``, ``!`` or ``?``, so ``i <3 u`` survives.
    Entities are left in place (see ``decode_basic_entities`` and ``unicode.unescape_entities``).
    """
    hidden = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"
    tag = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
    stripped = F.regexp_replace(F.regexp_replace(c, hidden, ""), tag, "")
    if always:
        return where_found(c, ("<",), stripped)
    return F.when(looks_like_html(c), stripped).otherwise(c)


def looks_like_html(c: Column) -> Column:
    return F.contains(c, F.lit("<")) & F.contains(c, F.lit(">"))


# The entities met in practice; the ampersand comes last so nothing is decoded twice.
BASIC_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"),
)


def decode_basic_entities(c: Column) -> Column:
    for entity, char in BASIC_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_markdown(c: Column) -> Column:
    """``[text](link)`` keeps its text; emphasis marks go."""
    unlinked = where_found(c, ("](",), F.regexp_replace(c, r"(?d)\[(.*?)\]\((.*?)\)", "$1"))
    return F.regexp_replace(unlinked, r"[*_`~]", "")


def strip_reddit(c: Column) -> Column:
    """Decode the three quote entities in this order, drop ``^`` and table rows ``|...|``."""
    plain = c
    for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.regexp_replace(F.replace(plain, F.lit("^"), F.lit("")), r"(?d)\|.*\|", "")
    return where_found(c, ("&", "^", "|"), plain)


# ---------------------------------------------------------------- social text

# Patterns of links, e-mail addresses and handles.
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MENTION_PATTERN = rf"@{WORD}+"


def strip_urls(c: Column) -> Column:
    return where_found(c, ("http", "www."), F.regexp_replace(c, URL_PATTERN, ""))


def strip_emails(c: Column) -> Column:
    return where_found(c, ("@",), F.regexp_replace(c, EMAIL_PATTERN, ""))


def strip_mentions(c: Column, action: str = "remove") -> Column:
    """``action="replace"`` leaves the neutral handle ``@user``."""
    handle = "@user" if action == "replace" else ""
    return where_found(c, ("@",), F.regexp_replace(c, MENTION_PATTERN, handle))


def split_camel(c: Column) -> Column:
    parted = F.regexp_replace(c, r"(?d)(.)([A-Z][a-z]+)", "$1 $2")
    return strip(F.regexp_replace(parted, r"([a-z0-9])([A-Z])", "$1 $2"))


def expand_hashtags(c: Column) -> Column:
    """Replace each tag, in order of appearance and everywhere, by its camel-case parts."""
    tags = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(#{WORD}+)"), F.lit(1)))
    expanded = F.aggregate(
        tags, c, lambda text, tag: F.replace(text, tag, split_camel(F.substring(tag, F.lit(2), F.length(tag))))
    )
    return where_found(c, ("#",), expanded)


def drop_name_marks(c: Column) -> Column:
    """Second half of the emoji step: underscores become spaces, colons go, in the whole text."""
    return where_found(c, ("_", ":"), F.translate(c, "_:", " "))


# ---------------------------------------------------------------- characters

# Code points treated as double and single quotes.
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u00b4\u2032"


def squeeze_repeats(c: Column) -> Column:
    """A run of three or more equal characters becomes two."""
    return F.regexp_replace(c, r"(?d)(.)\1{2,}", "$1$1")


def straighten_quotes(c: Column) -> Column:
    straight = F.translate(
        c, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES)
    )
    return where_found(c, tuple(DOUBLE_QUOTES + SINGLE_QUOTES), straight)


def squeeze_punctuation(c: Column) -> Column:
    short = c
    for pattern, mark in ((r"!{2,}", "!!"), (r"\?{2,}", "??"), (r"\.{3,}", "...")):
        short = F.regexp_replace(short, pattern, mark)
    return where_found(c, ("!!!", "???", "...."), short)


# Controls, zero-width characters and direction marks.
INVISIBLE = r"[\x00-\x1F\x7F-\x9F\u200b-\u200d\u200f\u202a-\u202e]"


def strip_invisible(c: Column, control_chars: str = "space") -> Column:
    """Drop invisible characters; with ``"space"`` the line-breaking controls become a space first."""
    if control_chars == "space":
        c = F.regexp_replace(c, r"[\t-\r\x1c-\x1f\x85]", " ")
    elif control_chars != "delete":
        raise ValueError("control_chars is 'space' or 'delete'")
    return F.regexp_replace(c, INVISIBLE, "")


# Spellings used to dodge word filters, and the words they stand for.
OBFUSCATIONS = (
    (r"\ba[s\$][s\$]\b", "ass"),
    (r"\bb[i\!][t\$]ch\b", "bitch"),
    (r"\bf[u\*]ck\b", "fuck"),
    (r"\bh[a4]te\b", "hate"),
    (r"\bl0ve\b", "love"),
    (r"\bp[e3]n[i1]s\b", "penis"),
    (r"\br[a4]p[e3]\b", "rape"),
    (r"\b[s\$]h[i1]t\b", "shit"),
    (r"\bn[i1]gg[a4]r?\b", "nigger"),
    (r"\bf[a4]gg[o0]t\b", "faggot"),
)
LEGACY_OBFUSCATIONS = OBFUSCATIONS[:8]


def expand_obfuscations(c: Column, rules=OBFUSCATIONS) -> Column:
    """Apply the rules in order, to texts in which one test for all of them finds something to do.

    A rule's letters are looked for before its word boundary, which costs far more at each place of a text.
    """
    firsts = [re.match(r"\\b(?:\[([^\]\[^&]+)\]|([A-Za-z0-9]))(?![?*{])(?!.*\|)", pattern) for pattern, _ in rules]
    ahead = "(?=[" + "".join(m[1] or m[2] for m in firsts) + "])" if all(firsts) else ""
    somewhere = f"(?i){ahead}(?:" + "|".join(pattern.replace(r"\b", "") for pattern, _ in rules) + ")"
    expanded = c
    for pattern, word in rules:
        ahead = f"(?={pattern[2:]})" if pattern.startswith(r"\b") else ""
        expanded = F.regexp_replace(expanded, "(?iU)" + ahead + pattern, word)
    return F.when(c.rlike(somewhere), expanded).otherwise(c)


def fallback_text(cleaned: Column, raw: Column) -> Column:
    """Text to score: the cleaned one, else the stripped raw one, else a fixed phrase."""
    return F.coalesce(
        F.when(~is_blank(cleaned), cleaned), F.nullif(strip(raw), F.lit("")), F.lit("empty input")
    )
