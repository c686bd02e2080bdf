"""The composed cleaner: an ordered list of column steps over one projection chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.functions import unicode as un
from labelmill.operators.language import detected_language
from labelmill.operators.names import mask_names


@dataclass(frozen=True)
class Step:
    name: str
    apply: Callable[[Column], Column]


def _html_steps(always: bool) -> tuple[Step, Step]:
    """Tags go first, then entities are decoded, in one test-and-strip and one Arrow step.

    A text without tags keeps its entities unless ``always`` is set; the mark of a stripped text is a
    leading NUL, which no cleaned text holds.
    """
    if always:
        return Step("html_tags", lambda c: tx.strip_tags(c, always=True)), Step("html_entities", un.unescape_entities)
    mark = "\x00"
    return (
        Step("html_tags", lambda c: F.when(tx.looks_like_html(c), F.concat(F.lit(mark), tx.strip_tags(c, always=True))).otherwise(c)),
        Step("html_entities", lambda c: un.unescape_marked(c, mark)),
    )


# The default cleaner. A caller's cleaner is a list of steps: these, some of them, or others in between.
STEPS = (
    Step("blank", tx.guard_blank),
    Step("unicode", un.repair_unicode),
    *_html_steps(always=False),
    Step("markdown", tx.strip_markdown),
    Step("reddit", tx.strip_reddit),
    Step("urls", tx.strip_urls),
    Step("emails", tx.strip_emails),
    Step("mentions", tx.strip_mentions),
    Step("hashtags", tx.expand_hashtags),
    Step("emojis", un.name_emojis),
    Step("emoji_marks", tx.drop_name_marks),
    Step("repeats", tx.squeeze_repeats),
    Step("quotes", tx.straighten_quotes),
    Step("punctuation", tx.squeeze_punctuation),
    Step("invisible", tx.strip_invisible),
    Step("obfuscation", tx.expand_obfuscations),
    Step("lower", tx.lower),
    Step("space", tx.squeeze_space),
)

# The older cleaner: fewer steps, HTML first, names masked.
OLDER_STEPS = (
    Step("blank", tx.guard_blank),
    *_html_steps(always=True),
    Step("unicode", un.nfkc),
    Step("urls", tx.strip_urls),
    Step("mentions", tx.strip_mentions),
    Step("hashtags", tx.expand_hashtags),
    Step("emojis", un.name_emojis),
    Step("emoji_marks", tx.drop_name_marks),
    Step("repeats", tx.squeeze_repeats),
    Step("obfuscation", lambda c: tx.expand_obfuscations(c, tx.LEGACY_OBFUSCATIONS)),
    Step("names", mask_names),
    Step("lower", tx.lower),
    Step("space", tx.squeeze_space),
)


def leave_out(steps: tuple[Step, ...], *names: str) -> tuple[Step, ...]:
    """The steps but for those named; an unknown name is an error."""
    unknown = set(names) - {s.name for s in steps}
    if unknown:
        raise ValueError(f"no such steps: {sorted(unknown)}")
    return tuple(s for s in steps if s.name not in names)


def replace_step(steps: tuple[Step, ...], name: str, apply: Callable[[Column], Column]) -> tuple[Step, ...]:
    """The steps with another function in the place of one."""
    leave_out(steps, name)
    return tuple(Step(name, apply) if s.name == name else s for s in steps)


def clean_text(df: DataFrame, text: str = "text", steps: tuple[Step, ...] = STEPS, out: str | None = None) -> DataFrame:
    """Run ``steps`` over ``text`` into ``out`` (default: in place).

    One ``withColumn`` per step: Catalyst merges the projections where that repeats no work.
    """
    out = out or text
    df = df.withColumn(out, F.col(text))
    for step in steps:
        df = df.withColumn(out, step.apply(F.col(out)))
    return df


def clean_legacy(df: DataFrame, text: str = "text", steps: tuple[Step, ...] = OLDER_STEPS, language: str | None = "en",
                 out: str = "clean_text") -> DataFrame:
    """The older cleaner; a text in another ``language`` comes out empty."""
    df = clean_text(df, text, steps, out)
    if language:
        lang = detected_language(F.col(out), ascii_shortcut=False)
        df = df.withColumn(out, F.when(lang.isin(language, "unknown"), F.col(out)).otherwise(""))
    return df


def tag_cleaned(df: DataFrame, text: str = "text", steps: tuple[Step, ...] = STEPS, language: str | None = "en") -> DataFrame:
    """Clean and add ``drop_reason``: ``empty``, ``language`` or null for rows to keep."""
    df = clean_text(df, text, steps)
    reason = F.when(F.col(text) == "", "empty")
    if language:
        lang = detected_language(F.col(text))
        reason = reason.when(~lang.isin(language, "unknown"), "language")
    return df.withColumn("drop_reason", reason)


def kept(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def cleaning_stats(tagged: DataFrame, source: str = "source") -> DataFrame:
    """Rows in, rows out, rows skipped by reason and reduction in percent, per source."""
    n, out = F.count(F.lit(1)), F.count_if(F.col("drop_reason").isNull())
    return tagged.groupBy(source).agg(
        n.alias("input_samples"),
        out.alias("output_samples"),
        F.count_if(F.col("drop_reason") == "empty").alias("skipped_empty"),
        F.count_if(F.col("drop_reason") == "language").alias("skipped_language"),
        F.coalesce(F.round(F.try_divide((n - out) * F.lit(100.0), n), 2), F.lit(0.0)).alias("reduction_rate_pct"),
    )
