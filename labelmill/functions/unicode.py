"""The few text steps for which Spark has no SQL function, as Arrow batch functions.

Each is applied only to rows that need it: the other rows hand a null to Python,
so plain ASCII text never crosses the process border.
"""

from __future__ import annotations

import html
import json
import re
import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel to the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# UTF-8 read as cp1252 shows a lead byte in one of these letters and then characters of the
# cp1252 image of 0x80-0xBF.
_CONTINUATION = re.escape("".join(
    bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xC0)
))
MISREAD = (
    f"[\u00c2-\u00c5\u00ce-\u00d1][{_CONTINUATION}]|[\u00e0-\u00e5\u00e9-\u00ef][{_CONTINUATION}]{{2}}"
    f"|\u00f0[{_CONTINUATION}]{{3}}"
)
_MISREAD = re.compile(MISREAD)
_ESCAPE_CODES = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]")
_BREAKS = re.compile("\r\n|[\r\x85\u2028\u2029]")
_CONTROLS = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff\ufff9-\ufffb]")


def _to_byte(ch: str) -> bytes:
    """cp1252, with its five holes mapped to the byte of the same number."""
    try:
        return ch.encode("cp1252")
    except UnicodeEncodeError:
        return bytes([ord(ch)])  # raises ValueError above 0xFF: not a cp1252 text


def undo_misread(text: str) -> str:
    """Undo UTF-8 text that was decoded as cp1252, when the bytes prove it."""
    if not _MISREAD.search(text):
        return text
    try:
        return b"".join(map(_to_byte, text)).decode("utf-8")
    except (UnicodeDecodeError, ValueError):
        pass  # only part of the text is misread: repair the runs that validate

    def one(match):
        try:
            return b"".join(map(_to_byte, match.group())).decode("utf-8")
        except (UnicodeDecodeError, ValueError):
            return match.group()

    return _MISREAD.sub(one, text)


def repair_text(text: str) -> str:
    """Entities (outside mark-up), misread UTF-8, escape codes, line breaks, controls, then NFKC."""
    if "<" not in text:
        text = html.unescape(text)
    text = _ESCAPE_CODES.sub("", undo_misread(text))
    text = _CONTROLS.sub("", _BREAKS.sub("\n", text))
    return unicodedata.normalize("NFKC", text)


SLICE = 64  # texts that are Python objects at one time


def _sliced(fn):
    def apply(batch: pa.Array) -> pa.Array:
        texts = (t for i in range(0, len(batch), SLICE) for t in batch.slice(i, SLICE).to_pylist())
        return pa.array((None if t is None else fn(t) for t in texts), pa.string(), size=len(batch))

    return apply



def _arrow(fn):
    """Arrow batch function. Declared non-deterministic only as a barrier: Catalyst otherwise folds all
    projections between two Python functions into one and repeats their expressions without limit."""
    return F.arrow_udf(_sliced(fn), T.StringType()).asNondeterministic()


def _marked(texts: pa.Array, found: pa.Array) -> pa.Array:
    def slices():
        for i in range(0, len(texts), SLICE):
            yield from zip(texts.slice(i, SLICE).to_pylist(), found.slice(i, SLICE).to_pylist())

    def marked(text, listed):
        if text is None or not listed:
            return None
        listed = set(listed)
        return "  ".join("\t" + t if t in listed else t for t in text.split(" "))

    return pa.array((marked(*r) for r in slices()), pa.string(), size=len(texts))


def mark_listed(tokens: Column, listed: Column) -> Column:
    """``tokens``, which hold no white space, joined by two blanks, with a tab before each that is in the array ``listed``.

    Texts for which nothing is listed don't go to Python.
    """
    some = F.size(listed) > 0
    marked = F.arrow_udf(_marked, T.StringType()).asNondeterministic()
    return F.coalesce(marked(F.when(some, F.array_join(tokens, " ")), listed), F.array_join(tokens, "  "))


_repair = _arrow(repair_text)
_nfkc = _arrow(lambda t: unicodedata.normalize("NFKC", t))
_unescape = _arrow(html.unescape)

# Characters that NFKC leaves alone and that no misread text contains: ASCII, Latin-1 letters, Cyrillic, kana,
# CJK and Hangul. Texts made of these alone need no normalization and no repair.
UNSTABLE = (
    r"[^\x00-\x7F\u00C0-\u00FF\u0400-\u045F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]"
)
NON_ASCII = r"[^\x00-\x7F]"


def _where_needed(c: Column, need: Column, fn) -> Column:
    return F.coalesce(fn(F.when(need, c)), c)


def _unstable(c: Column) -> Column:
    # the wide class is slow per character: it only sees what is left without ASCII
    return F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(UNSTABLE)


def repair_unicode(c: Column) -> Column:
    entity = F.contains(c, F.lit("&")) & c.rlike("&[#A-Za-z]")
    return _where_needed(c, _unstable(c) | entity | c.rlike(r"[\x00-\x08\x0b\x0d-\x1f\x7f]"), _repair)


def nfkc(c: Column) -> Column:
    return _where_needed(c, _unstable(c), _nfkc)


# Blocks that hold pictographs, as (first, last) code points.
EMOJI_RANGES = (
    (0x231A, 0x231B), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x2600, 0x27BF), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C),
    (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x1F000, 0x1F02F), (0x1F0A0, 0x1F0FF), (0x1F100, 0x1F2FF), (0x1F300, 0x1FAFF),
)
EMOJI = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in EMOJI_RANGES) + "]"


@cache
def emoji_names() -> str:
    """JSON object from pictograph to its spoken name, taken from the Unicode database."""
    return json.dumps(
        {chr(n): unicodedata.name(chr(n), "symbol").lower() for a, b in EMOJI_RANGES for n in range(a, b + 1)}
    )


# What reads as one sign: a flag of two letters, a keycap, or pictographs with their skin tones, joined.
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
PICTURE = EMOJI + r"[\x{FE0E}\x{FE0F}]?(?:[\x{1F3FB}-\x{1F3FF}]\x{FE0F}?)?"
SIGN = rf"{FLAG}|{KEYCAP}|{PICTURE}(?:\x{{200D}}{PICTURE})*\x{{200D}}?"


def name_emojis(c: Column) -> Column:
    """Each pictograph, flag, keycap or joined sequence, the longest that fits, becomes one name between blanks.

    A sequence is named by its parts; joiners and variation marks go.
    """
    names = F.from_json(F.lit(emoji_names()), "map<string,string>")
    letters = "".join(chr(0x1F1E6 + i) for i in range(26))

    def named(sign: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(sign, F.lit(EMOJI), F.lit(0)), lambda e: F.element_at(names, e))
        return (F.when(sign.rlike(f"^{FLAG}$"), F.concat(F.lit("flag "), F.translate(sign, letters, "abcdefghijklmnopqrstuvwxyz")))
                .when(sign.rlike("^[0-9#*]"), F.concat(F.lit("keycap "), F.left(sign, F.lit(1)))).otherwise(F.array_join(parts, " ")))

    gaps, signs = F.split(c, SIGN, -1), F.regexp_extract_all(c, F.lit(SIGN), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), signs.alias("sign"))
    spoken = F.array_join(F.transform(pairs, lambda p: F.concat(
        p["gap"], F.when(p["sign"].isNull(), "").otherwise(F.concat(F.lit(" "), named(p["sign"]), F.lit(" "))))), "")
    return F.when(F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(rf"{EMOJI}|\x{{20E3}}"), spoken).otherwise(c)


def unescape_entities(c: Column) -> Column:
    """All HTML entities, named and numeric."""
    return _where_needed(c, F.contains(c, F.lit("&")) & c.rlike("&[#A-Za-z]"), _unescape)


def unescape_marked(c: Column, mark: str) -> Column:
    """Decode entities of the texts that start with ``mark`` and drop the mark."""
    marked = F.startswith(c, F.lit(mark))
    body = F.substring(c, F.lit(2), F.length(c))
    decoded = _unescape(F.when(marked & c.rlike("&[#A-Za-z]"), body))
    return F.coalesce(decoded, F.when(marked, body).otherwise(c))
