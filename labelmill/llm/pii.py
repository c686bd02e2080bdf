"""Personal data by rules: patterns propose spans, checksums confirm them, context words adjust a score.

Everything is column expressions: for each kind, ``split`` gives the stretches between the matches of a pattern and
``regexp_extract_all`` the matches; their lengths in code points add up to the offsets. Running sums go in two levels, over about
the square root of n groups, so that a text of many matches is not copied for each of them. No shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import whole, Carried


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                          .otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check (letters count 10 to 35, the first four places go last)."""
    packed = F.regexp_replace(value, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(packed, 5, 1000), F.substring(packed, 1, 4))
    numbers = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""),
                          lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _octets(value: Column) -> Column:
    plain = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``valid`` confirms; ``score`` plus ``bonus`` (context before the match) must reach ``least``."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    context: str
    score: float
    bonus: float = 0.2
    least: float = 0.0
    needs: str = ""  # a character without which no match is possible


# Possessive forms and the look-behinds accept exactly what the plain forms do; they keep long runs linear.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), "mail|contact|write", 0.8, needs="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, "ip|host|server|address", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda v: digit_count(v).between(16, 19) & luhn(v), "card|visa|credit|payment", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: digit_count(v).between(8, 15), "tel|phone|call|mobile|fax", 0.6, needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", mod97, "iban|account|konto", 0.8, least=0.7),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+", lambda v: F.lit(True), "token|secret|passw(?:or)?d|api.?key", 0.4, 0.4, 0.7),
)
BASE = ("email", "ip", "card", "phone")
FOUND = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(numbers: Column) -> Column:
    """The sums of an array of longs up to and with each element."""
    none = F.array().cast("array<bigint>")

    def add_up(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("sums"))
        return F.aggregate(part, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"] + x)).alias("sums")), lambda a: a["sums"])

    def in_groups(every: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        groups = F.transform(F.sequence(F.lit(1), F.size(every), width), lambda at: F.slice(every, at, width))
        zero = F.lit(0).cast("long")
        totals = lambda parts: add_up(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)
        return _let(groups, lambda parts: _let(totals(parts), lambda ends: F.flatten(
            F.transform(parts, lambda p, i: add_up(p, F.coalesce(F.get(ends, i - F.lit(1)), zero))))))

    return _let(numbers, lambda every: F.when(F.size(every) > 0, in_groups(every)).otherwise(none))


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order; offsets in code points, end exclusive."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def span(pair, end):
        hit = pair["hit"]
        near = F.right(pair["gap"], F.lit(24)).rlike(f"(?i)(?:{kind.context})")
        score = F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0.0)
        made = F.struct(F.lit(kind.name).alias("kind"), (end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("value"), score.alias("score"))
        return F.when(kind.valid(hit) & (score >= kind.least), made)

    def spans(pairs):
        lengths = F.transform(pairs, lambda p: (F.char_length(p["gap"]) + F.char_length(p["hit"])).cast("long"))
        return _let(running_sums(lengths), lambda ends: F.array_compact(F.zip_with(pairs, ends, span)))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    found = F.when(F.size(hits) > 0, _let(pairs, spans)).otherwise(F.array()).cast(FOUND)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast(FOUND)) if kind.needs else found


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: spans ``(kind, start, end, value, score)`` of the whole text, by kind as listed, then start.

    Matches of a kind are the leftmost that don't overlap; one that its check rejects is dropped without another try. The
    four base kinds don't depend on context; account numbers must pass mod 97, secrets need a context word such as
    ``token`` before them. Null or empty text: no spans. A column named ``pii`` is replaced, all others stay.
    """
    rest = Carried(docs, "pii")
    each = docs.select(*rest.cols, *[spans_of(whole(text_col), k).alias(f"_pii_{k.name}") for k in kinds])
    return each.select(*rest.back(), F.concat(*[F.col(f"_pii_{k.name}") for k in kinds]).alias("pii"))


def redact(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` of :func:`find_pii` with each span replaced by ``[KIND]``; of overlapping spans the first stays.

    Null texts stay null, texts without spans as they are; all columns stay. No rows: no rows.
    """
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        add = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), add.alias("out"))).otherwise(acc)

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.lit(2**31 - 1))))
    return docs.withColumn(text_col, done)
