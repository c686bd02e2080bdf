import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.functions import unicode as un
from labelmill.operators import clean, language, names


@pytest.mark.parametrize(
    ("fn", "given_text", "expected"),
    [
        (tx.squeeze_repeats, "looooove", "loove"),
        (tx.squeeze_repeats, "a\n\n\n\nb", "a\n\n\n\nb"),
        (tx.expand_hashtags, "#StopTheNoise now", "Stop The Noise now"),
        (tx.expand_hashtags, "#foo #foobar", "foo foobar"),
        (tx.strip_mentions, "hi @ünal", "hi "),
        (lambda c: tx.strip_mentions(c, "replace"), "hi @you there", "hi @user there"),
        (tx.strip_markdown, "[t](http://u) **b**", "t b"),
        (tx.strip_reddit, "&amp;gt; x^2 a |b| c", "&gt; x2 a  c"),
        (tx.strip_urls, "see https://a.b/c or www.x.org/y.", "see  or "),
        (lambda c: tx.strip_emails(tx.strip_urls(c)), "see https://a.b/c or m@x.org", "see  or "),
        (un.repair_unicode, "ﬁ…", "fi..."),
        (un.repair_unicode, "cafÃ©", "café"),
        (un.repair_unicode, "CAFÉ»", "CAFÉ»"),
        (un.repair_unicode, "a &amp; b &eacute;", "a & b é"),
        (un.repair_unicode, "\x1b[31mred\x1b[0m", "red"),
        (un.nfkc, "①", "1"),
        (un.name_emojis, "ok \U0001f600!", "ok  grinning face !"),
        (tx.drop_name_marks, "10:30 a_b", "1030 a b"),
        (tx.squeeze_punctuation, "a!!! b??? c....", "a!! b?? c..."),
        (tx.straighten_quotes, "“x” ’s «", "\"x\" 's \""),
        (lambda c: tx.strip_invisible(c, "delete"), "a\nb", "ab"),
        (tx.strip_invisible, "a\nb​c", "a bc"),
        (tx.split_camel, "HTTPServerName", "HTTP Server Name"),
        (tx.expand_obfuscations, "I h4te l0ve", "I hate love"),
        (tx.squeeze_space, " a  b\x1c c ", "a b c"),
        (tx.strip_tags, "<p>a<br>b</p><script>x<y</script><!-- c -->d", "abd"),
        (tx.strip_tags, "i <3 you", "i <3 you"),
        (tx.strip_tags, "i <3 you > me <b>x</b>", "i <3 you > me x"),
        (tx.guard_blank, " \t\n", ""),
        (tx.canonical, " AbC ", "abc"),
    ],
)
def test_steps(one, fn, given_text, expected):
    assert one(fn, given_text) == expected


def test_control_chars_option_is_checked(spark):
    with pytest.raises(ValueError):
        tx.strip_invisible(F.lit("a"), "other")


def test_fallback(spark):
    rows = spark.createDataFrame([("", " @user "), (" ", " \t"), ("x", "y"), (None, "z")], "c string, r string")
    got = [r[0] for r in rows.select(tx.fallback_text(F.col("c"), F.col("r"))).collect()]
    assert got == ["@user", "empty input", "x", "z"]


def test_composed_cleaner(spark):
    raw = ["<b>Hello</b> @you #NiceDay!!! see https://x.y &amp; **bold** sooooo\ngood", None, "   ", "“Q” \U0001f600"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, text string")
    got = [r["text"] for r in clean.clean_text(rows).orderBy("i").collect()]
    assert got == ["hello nice day!! see & bold soo good", "", "", '"q" grinning face']


def test_cleaner_switches(spark):
    steps = clean.leave_out(clean.STEPS, "lower", "urls", "punctuation", "repeats")
    rows = spark.createDataFrame([("Go http://a.b !!!!",)], "text string")
    assert clean.clean_text(rows, steps=steps).first()["text"] == "Go http//a.b !!!!"


    deleting = clean.replace_step(clean.STEPS, "invisible", lambda c: tx.strip_invisible(c, "delete"))
    assert clean.clean_text(spark.createDataFrame([("a\nb",)], "text string"), steps=deleting).first()["text"] == "ab"
    with pytest.raises(ValueError):
        clean.leave_out(clean.STEPS, "nothing")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=20, max_size=40))
def test_steps_are_idempotent(spark, texts):
    steps = {"urls": tx.strip_invisible, "quotes": tx.straighten_quotes, "punct": tx.squeeze_punctuation,
             "lower": tx.lower, "space": tx.squeeze_space, "repeats": tx.squeeze_repeats, "strip": tx.strip}
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    once = rows.select(*[fn(F.col("t")).alias(k) for k, fn in steps.items()])
    twice = once.select(*[(fn(F.col(k)) == F.col(k)).alias(k) for k, fn in steps.items()])
    assert all(all(r) for r in twice.collect())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=20, max_size=40))
def test_python_twins(spark, texts):
    """White space, words and NFKC agree with Python's own functions."""
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for t, s, w, n in rows.select(c, tx.strip(c), tx.words(c), un.nfkc(c)).collect():
        assert s == t.strip() and w == t.split() and n == unicodedata.normalize("NFKC", t)


def test_language(one):
    texts = ["the dog is here", "le chien est dans la maison é", "der Hund und die Katze sind schön", " ", "я ж"]
    assert one(language.detected_language, *texts) == ["en", "fr", "de", "unknown", "unknown"]
    assert one(lambda c: language.detected_language(c, False), "le chien est dans la maison", "zzz") == ["fr", "unknown"]


def test_cleaning_stats(spark):
    rows = spark.createDataFrame(
        [("a", "hello there"), ("a", "@x"), ("a", "le chien est dans la forêt et les bois"), ("b", "fine text")],
        "source string, text string")
    got = {r["source"]: r.asDict() for r in clean.cleaning_stats(clean.tag_cleaned(rows)).collect()}
    assert got["a"] == {"source": "a", "input_samples": 3, "output_samples": 1, "skipped_empty": 1,
                        "skipped_language": 1, "reduction_rate_pct": 66.67}
    assert got["b"]["output_samples"] == 1


def test_name_masking(one):
    assert one(names.mask_names, "Yesterday Mary Smith met john, Peter.") == "Yesterday someone someone met john , someone ."


def test_legacy_cleaner_drops_other_languages(spark):
    rows = spark.createDataFrame([("Le chien est dans la maison",), ("The dog is in the house of Mary",)], "text string")
    got = [r["clean_text"] for r in clean.clean_legacy(rows).collect()]
    assert got == ["", "the dog is in the house of someone"]


def test_emoji_sequences(one):
    """A flag, keycap, skin tone or joined family is one name; half a flag and a joiner at the end are no sequence."""
    texts = ["\U0001F1E9\U0001F1EA\U0001F1EB\U0001F1F7", "press 1\uFE0F\u20E3 or #\u20E3", "ok\U0001F44D\U0001F3FD\U0001F44D", "\U0001F468\u200D\U0001F469\u200D\U0001F467!",
             "\U0001F1E9 x", "a\u2764\uFE0F\u200Db", "plain 1 # *", None]
    assert one(un.name_emojis, *texts) == [
        " flag de  flag fr ", "press  keycap 1  or  keycap # ", "ok thumbs up sign emoji modifier fitzpatrick type-4  thumbs up sign ", " man woman girl !",
        " regional indicator symbol letter d  x", "a heavy black heart b", "plain 1 # *", None]


def test_rules_keep_their_boundaries(one):
    """Letters are looked for before the boundary: same texts, fewer boundary tests."""
    texts = ("A$S as$ class", "passer", "xass a$$x éass assé aſs ass", "B!TCH f*ck H4te", "", None)
    rules = tx.LEGACY_OBFUSCATIONS

    def plainly(c):
        for pattern, word in rules:
            c = F.regexp_replace(c, "(?iU)" + pattern, word)
        return c

    got = one(lambda c: tx.expand_obfuscations(c, rules), *texts)
    assert got == one(plainly, *texts) and got[1] == "passer" and got[3] == "bitch fuck hate"
    assert one(lambda c: tx.expand_obfuscations(c, ((r"\bx?y\b", "z"), (r"\ba|b\b", "c"))), "xy y", "a b", "q") == ["z z", "c c", "q"]
    assert "(?=a[s" in str(tx.expand_obfuscations(F.col("t"), rules))


def test_tags_are_looked_for_where_a_bracket_is(one):
    assert one(lambda c: tx.strip_tags(c, always=True), "a > b", "<b>a</b> < c", "<!-- x -->y", None) == ["a > b", "a < c", "y", None]
    assert "contains" in str(tx.strip_tags(F.col("t"), always=True))


def test_names_are_looked_for_before_tokens_are_paired(one):
    assert one(names.mask_names, "Mary Smith met Bo , x", "No one Here", "", None) == ["someone someone met Bo , x", "No one Here", "", None]
    assert "exists" in str(names.mask_names(F.col("t")))
    assert one(lambda c: names.mask_names(c, ("", "Bo")), "Ann Bo x") == "someone someone x"


def test_few_texts_are_python_objects_at_one_time():
    import pyarrow as pa

    seen, most = [], []
    texts = pa.array(["a", None, "b"] * un.SLICE)
    out = un._sliced(lambda t: seen.append(t) or t.upper())(texts)
    assert out.to_pylist() == ["A", None, "B"] * un.SLICE and len(seen) == 2 * un.SLICE
    assert un._sliced(str.upper)(texts.slice(0, 0)).to_pylist() == []
    # the longest list made of the batch is a slice
    class Batch:
        def __len__(self):
            return len(texts)

        def slice(self, i, n):
            most.append(n)
            return texts.slice(i, n)
    assert un._sliced(str.upper)(Batch()).to_pylist() == out.to_pylist() and max(most) == un.SLICE
