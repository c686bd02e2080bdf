"""Queries over single texts: cleaning steps, noise, language, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.functions import unicode as un
from labelmill.operators import clean, language, model, names, noise
from labelmill.plans.registry import LABELLED_SQL, documents, labelled, query, sql_strip, sql_words, table


def _step(spark, d, step, name="documents", column="text", key="doc_id"):
    t = table(spark, d, name)
    return t.select(key, step(F.col(column)).alias("text"))


# What the tables lack, put around every text in both engines: tags, curly quotes, runs of marks, emoji names
# and an emoji, a ligature, and blank texts.
DRESSED_SQL = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(9) ELSE '#StopTheNoise #ab ' || chr(8220) || left(text, 40) || ' ' || chr(8221)
  || ' ' || chr(171) || ' ' || chr(187) || ' ' || chr(8217) || substr(text, 41) || ' End!!!! well??? so..... :red_heart: ' || chr(128512) || ' ' || chr(64257) || chr(8230) END AS text
  FROM documents)"""


def _dressed(spark, d, step):
    text = F.concat(F.lit("#StopTheNoise #ab \u201c"), F.substring("text", 1, 40), F.lit(" \u201d \u00ab \u00bb \u2019"), F.expr("substring(text, 41)"),
                    F.lit(" End!!!! well??? so..... :red_heart: \U0001f600 \ufb01\u2026"))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t")).otherwise(text).alias("text"))
    return rows.select("doc_id", step(F.col("text")).alias("text"))


CAMEL_SQL = ("trim(regexp_replace(regexp_replace({0}, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), "
             "'([a-z0-9])([A-Z])', '\\1 \\2', 'g'))")
HASHTAG_SQL = ("list_reduce(list_distinct(regexp_extract_all({0}, '#[\\p{{L}}\\p{{N}}_]+')), "
               "lambda acc, h: replace(acc, h, " + CAMEL_SQL.format("substr(h, 2)") + "), {0})")
REPEAT_SQL = ("array_to_string(list_transform(list_filter(list_zip(string_split({0}, ''), [NULL] || string_split({0}, ''), "
              "[NULL, NULL] || string_split({0}, '')), lambda z: z[1] IS NOT NULL AND NOT (z[1] <> chr(10) "
              "AND coalesce(z[1] = z[2] AND z[1] = z[3], false))), lambda z: z[1]), '')")
MARKDOWN_SQL = "regexp_replace(regexp_replace({0}, '\\[(.*?)\\]\\((.*?)\\)', '\\1', 'g'), '[*_`~]', '', 'g')"
REDDIT_SQL = ("regexp_replace(replace(replace(replace(replace({0}, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), "
              "'^', ''), '\\|.*\\|', '', 'g')")
URL_SQL = "regexp_replace({0}, 'https?://\\S+|www\\.\\S+', '', 'g')"
EMAIL_SQL = "regexp_replace({0}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '', 'g')"
MENTION_SQL = "regexp_replace({0}, '@[\\p{{L}}\\p{{N}}_]+', '{1}', 'g')"
QUOTE_SQL = ("translate({0}, chr(8220)||chr(8221)||chr(8222)||chr(8223)||chr(171)||chr(187)"
             "||chr(8216)||chr(8217)||chr(8218)||chr(8219)||chr(180)||chr(8242), '\"\"\"\"\"\"'||repeat(chr(39), 6))")
PUNCT_SQL = ("regexp_replace(regexp_replace(regexp_replace({0}, '!{{2,}}', '!!', 'g'), '\\?{{2,}}', '??', 'g'), "
             "'\\.{{3,}}', '...', 'g')")
CONTROL_SQL = ("regexp_replace(regexp_replace({0}, '[\\t-\\r\\x1c-\\x1f\\x{{85}}]', ' ', 'g'), "
               "'[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{200b}}-\\x{{200d}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}]', '', 'g')")
SPACE_SQL = "trim(regexp_replace({0}, '[\\s\\x0b]+', ' ', 'g'))"


def _obfuscation_sql(c: str, rules=tx.OBFUSCATIONS) -> str:
    for pattern, word in rules:
        c = f"regexp_replace({c}, '{pattern}', '{word}', 'gi')"
    return c


TAGS_SQL = (r"regexp_replace(regexp_replace(html, "
            r"'<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>',"
            r" '', 'gis'), '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')")
ENTITY_SQL = ("replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
              "'&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')")


@query(f"SELECT page_id, {ENTITY_SQL.format(TAGS_SQL)} AS text FROM pages")
def strip_html(spark, d):
    return _step(spark, d, lambda c: tx.decode_basic_entities(tx.strip_tags(c)), "pages", "html", "page_id")


@query("SELECT page_id, replace(replace(text, '&copy;', chr(169)), '&middot;', chr(183)) AS text FROM ("
       f"SELECT page_id, {ENTITY_SQL.format(TAGS_SQL)} AS text FROM pages)")
def strip_html_all_entities(spark, d):
    """The same with every named and numeric entity decoded (Arrow batches, only where one occurs)."""
    return _step(spark, d, lambda c: un.unescape_entities(tx.strip_tags(c, always=True)), "pages", "html", "page_id")


@query(f"SELECT page_id, {URL_SQL.format('html')} AS text, {URL_SQL.format('url')} AS url FROM pages")
def strip_urls(spark, d):
    return table(spark, d, "pages").select(
        "page_id", tx.strip_urls(F.col("html")).alias("text"), tx.strip_urls(F.col("url")).alias("url"))


@query(f"SELECT doc_id, {EMAIL_SQL.format('text')} AS text FROM documents")
def clean_emails(spark, d):
    return _step(spark, d, tx.strip_emails)


@query(f"SELECT doc_id, {MENTION_SQL.format('text', '')} AS removed, {MENTION_SQL.format('text', '@user')} AS replaced FROM documents")
def clean_mentions(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.strip_mentions(F.col("text")).alias("removed"),
        tx.strip_mentions(F.col("text"), "replace").alias("replaced"))


@query(f"SELECT page_id, {MARKDOWN_SQL.format('html')} AS text FROM pages")
def strip_markdown(spark, d):
    return _step(spark, d, tx.strip_markdown, "pages", "html", "page_id")


@query(f"SELECT page_id, {REDDIT_SQL.format('html')} AS text FROM pages")
def strip_reddit(spark, d):
    return _step(spark, d, tx.strip_reddit, "pages", "html", "page_id")


@query(f"SELECT doc_id, {HASHTAG_SQL.format('text')} AS text FROM {DRESSED_SQL}")
def expand_hashtags(spark, d):
    return _dressed(spark, d, tx.expand_hashtags)


@query("SELECT c_custkey, " + CAMEL_SQL.format("c_name || c_mktsegment || 'NextPart'") + " AS text FROM customer")
def split_camel(spark, d):
    text = F.concat("c_name", "c_mktsegment", F.lit("NextPart"))
    return table(spark, d, "customer").select("c_custkey", tx.split_camel(text).alias("text"))


@query(f"SELECT doc_id, {REPEAT_SQL.format('text')} AS text FROM documents")
def squeeze_repeats(spark, d):
    return _step(spark, d, tx.squeeze_repeats)


@query(f"SELECT doc_id, {QUOTE_SQL.format('text')} AS text FROM {DRESSED_SQL}")
def norm_quotes(spark, d):
    return _dressed(spark, d, tx.straighten_quotes)


@query(f"SELECT doc_id, {PUNCT_SQL.format('text')} AS text FROM {DRESSED_SQL}")
def norm_punct(spark, d):
    return _dressed(spark, d, tx.squeeze_punctuation)


@query(f"SELECT doc_id, {CONTROL_SQL.format('text')} AS spaced, replace(text, chr(10), '') AS deleted FROM documents")
def strip_controls(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.strip_invisible(F.col("text")).alias("spaced"),
        tx.strip_invisible(F.col("text"), "delete").alias("deleted"))


@query(f"SELECT doc_id, replace(replace(text, '_', ' '), ':', '') AS text FROM {DRESSED_SQL}")
def drop_name_marks(spark, d):
    return _dressed(spark, d, tx.drop_name_marks)


@query(f"SELECT doc_id, replace(text, chr(128512), ' grinning face ') AS text FROM {DRESSED_SQL}")
def name_emojis(spark, d):
    return _dressed(spark, d, un.name_emojis)


# A flag, a keycap, a skin tone and a joined family, by turns.
SIGNS = ("\U0001F1E9\U0001F1EA", "7\uFE0F\u20E3", "\U0001F44D\U0001F3FD", "\U0001F468\u200D\U0001F469\u200D\U0001F467")


@query("""SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' flag de ' WHEN 1 THEN ' keycap 7 '
  WHEN 2 THEN ' thumbs up sign emoji modifier fitzpatrick type-4 ' ELSE ' man woman girl ' END || '!' AS text FROM documents""")
def emoji_sequences(spark, d):
    sign = F.get(F.array(*[F.lit(x) for x in SIGNS]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", un.name_emojis(F.concat("text", sign, F.lit("!"))).alias("text"))


@query(f"SELECT doc_id, replace(replace(nfc_normalize(text), chr(64257), 'fi'), chr(8230), '...') AS text FROM {DRESSED_SQL}")
def normalize_unicode(spark, d):
    """Repair and NFKC; the twin spells out the two compatibility characters that the texts hold."""
    return _dressed(spark, d, un.repair_unicode)


# Neutral rules that occur in the tables; the shipped rule table is covered by unit tests and the composed cleaner.
NEUTRAL_RULES = ((r"\bth[ae]t\b", "that"), (r"\b[i1]s\b", "is"), (r"\bt[o0]\b", "to"))


@query(f"SELECT doc_id, {_obfuscation_sql('text', NEUTRAL_RULES)} AS text, {_obfuscation_sql('text')} AS shipped FROM documents")
def deobfuscate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.expand_obfuscations(F.col("text"), NEUTRAL_RULES).alias("text"),
        tx.expand_obfuscations(F.col("text")).alias("shipped"))


@query(f"SELECT doc_id, {SPACE_SQL.format('text')} AS text FROM documents")
def squeeze_ws(spark, d):
    return _step(spark, d, tx.squeeze_space)


@query(f"SELECT doc_id, {sql_strip('lower(text)')} AS text FROM documents")
def canonical_key(spark, d):
    return _step(spark, d, tx.canonical)


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {sql_strip('text')} = '' THEN '' ELSE text END AS text FROM {DRESSED_SQL}")
def blank_guard(spark, d):
    return _dressed(spark, d, tx.guard_blank)


@query(f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS text FROM documents")
def token_join(spark, d):
    return _step(spark, d, lambda c: tx.join_tokens(tx.words(c)))




@query(f"""SELECT doc_id, CASE WHEN trim(cleaned) <> '' THEN cleaned
             WHEN {sql_strip('text')} <> '' THEN {sql_strip('text')} ELSE 'empty input' END AS text
           FROM (SELECT doc_id, text, regexp_replace(text, '[^A-Z]', '', 'g') AS cleaned FROM documents)""")
def scoring_fallback(spark, d):
    cleaned = F.regexp_replace("text", "[^A-Z]", "")
    return table(spark, d, "documents").select("doc_id", tx.fallback_text(cleaned, F.col("text")).alias("text"))


def _cleaned_sql() -> str:
    """The composed cleaner in SQL, one CTE per step. Emoji, mojibake and tags do not occur in ``documents``."""
    steps = [
        MARKDOWN_SQL.format("text"), REDDIT_SQL.format("text"), URL_SQL.format("text"), EMAIL_SQL.format("text"),
        MENTION_SQL.format("text", ""), HASHTAG_SQL.format("text"),
        "replace(replace(text, '_', ' '), ':', '')", REPEAT_SQL.format("text"), QUOTE_SQL.format("text"),
        PUNCT_SQL.format("text"), CONTROL_SQL.format("text"), _obfuscation_sql("text"), "lower(text)",
        SPACE_SQL.format("text"),
    ]
    ctes = ["s0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"]
    for i, s in enumerate(steps, 1):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT doc_id, source, lang, {s} AS text FROM s{i - 1})")
    return ",\n".join(ctes) + f",\ncleaned AS (SELECT * FROM s{len(steps)})"


CLEANED_SQL = _cleaned_sql()


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _lang_sql(text: str, shortcut: bool) -> str:
    tokens = f"regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"
    votes = {k: f"len(list_filter({tokens}, lambda w: w IN {_list(v)}))" for k, v in language.PROFILES.items()}
    order = list(votes)
    best = f"greatest({', '.join(votes.values())})"
    arms = " ".join(f"WHEN {votes[k]} = {best} THEN '{k}'" for k in order)
    ascii_arm = f"WHEN NOT regexp_matches({text}, '[^\\x00-\\x7f]') THEN 'en'" if shortcut else ""
    return (f"CASE WHEN {text} IS NULL OR {sql_strip(text)} = '' THEN 'unknown' {ascii_arm} "
            f"WHEN {best} = 0 THEN 'unknown' {arms} END")


@query(f"SELECT doc_id, lang, {_lang_sql('text', True)} AS detected, {_lang_sql('text', False)} AS voted FROM documents")
def language_vote(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", "lang", language.detected_language(c).alias("detected"),
        language.detected_language(c, ascii_shortcut=False).alias("voted"))


@query(f"SELECT doc_id, lang FROM documents WHERE {_lang_sql('text', False)} IN ('fr', 'unknown')")
def language_filter(spark, d):
    return language.filter_language(table(spark, d, "documents"), "text", "fr", ascii_shortcut=False).select("doc_id", "lang")


# Every eleventh text is put into a script that the tables lack.
SCRIPTED_SQL = """scripted AS (SELECT doc_id, lang, CASE doc_id % 11 WHEN 0 THEN 'Съешь ещё этих мягких булок, ok?' WHEN 1 THEN 'هذا نص قصير' WHEN 2 THEN '短い文です 2024' WHEN 3 THEN '12 !!' ELSE text END AS text FROM documents)"""
GRAMS_SQL = """unnest(flatten(list_transform(regexp_extract_all(lower(text), '\\p{L}+'),
  lambda w: list_transform(generate_series(1, length(w)), lambda i: substr('_' || w || '_', i, 3)))))"""
LANGUAGE_SQL = f"""{SCRIPTED_SQL},
seen AS (SELECT lang, {GRAMS_SQL} AS gram FROM documents WHERE lang IS NOT NULL),
counts AS (SELECT lang, gram, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM seen GROUP BY lang, gram),
vocabulary AS (SELECT DISTINCT gram FROM counts WHERE n * {language.GRAM_SHARE} >= total),
weights AS (
  SELECT l.lang, v.gram, CAST(round(1000 * ln((coalesce(c.n, 0) + 0.5::DOUBLE) / (l.total + 0.5::DOUBLE * (SELECT count(*) FROM vocabulary)))) AS BIGINT) AS w
  FROM vocabulary v CROSS JOIN (SELECT DISTINCT lang, total FROM counts) l LEFT JOIN counts c ON c.lang = l.lang AND c.gram = v.gram),
judged AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'cyrillic' WHEN doc_id % 11 = 1 THEN 'arabic' WHEN doc_id % 11 = 2 THEN 'cjk' END AS script FROM scripted),
sums AS (SELECT doc_id, w.lang, sum(w.w) AS w FROM (SELECT doc_id, {GRAMS_SQL} AS gram FROM judged WHERE script IS NULL) g JOIN weights w USING (gram) GROUP BY 1, 2),
best AS (SELECT doc_id, lang AS best FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) = 1),
named AS (SELECT doc_id, lang, coalesce(script, best, 'unknown') AS detected FROM judged LEFT JOIN best USING (doc_id))"""
SCRIPT_TEXTS = ("Съешь ещё этих мягких булок, ok?", "هذا نص قصير", "短い文です 2024", "12 !!")


def _scripted(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "text")
    text = F.col("text")
    for i, other in enumerate(SCRIPT_TEXTS):
        text = F.when(F.col("doc_id") % 11 == i, other).otherwise(text)
    return rows.withColumn("text", text), language.learn_profiles(rows)


@query(f"WITH {LANGUAGE_SQL} SELECT * FROM named")
def language_ngrams(spark, d):
    """Language by learnt trigram profiles and scripts."""
    rows, profiles = _scripted(spark, d)
    return rows.select("doc_id", "lang").join(language.detect_language(rows, profiles, key="doc_id"), "doc_id")


@query(f"WITH {LANGUAGE_SQL} SELECT doc_id, lang FROM named WHERE detected IN ('en', 'unknown')")
def language_filter_learnt(spark, d):
    rows, profiles = _scripted(spark, d)
    return language.keep_language(rows, profiles, "en", key="doc_id").select("doc_id", "lang")


@query(f"WITH {CLEANED_SQL} SELECT doc_id, text FROM cleaned")
def clean_documents(spark, d):
    return clean.clean_text(table(spark, d, "documents").select("doc_id", "text"))


@query(f"""WITH {CLEANED_SQL},
tagged AS (SELECT source, CASE WHEN text = '' THEN 'empty'
             WHEN {_lang_sql('text', True)} NOT IN ('en', 'unknown') THEN 'language' END AS drop_reason FROM cleaned)
SELECT source, count(*) AS input_samples, count(*) FILTER (drop_reason IS NULL) AS output_samples,
  count(*) FILTER (drop_reason = 'empty') AS skipped_empty,
  count(*) FILTER (drop_reason = 'language') AS skipped_language,
  round(100.0::DOUBLE * count(*) FILTER (drop_reason IS NOT NULL) / count(*), 2) AS reduction_rate_pct
FROM tagged GROUP BY source""")
def clean_accounting(spark, d):
    return clean.cleaning_stats(clean.tag_cleaned(table(spark, d, "documents")))


@query()
def clean_pages(spark, d):
    """The composed cleaner on real mark-up."""
    return clean.clean_text(table(spark, d, "pages").select("page_id", F.col("html").alias("text")))


@query()
def clean_legacy_documents(spark, d):
    return clean.clean_legacy(table(spark, d, "documents").select("doc_id", "text"))


# Words that do occur in the tables stand in for given names.
STAND_IN_NAMES = ("The", "Is", "And", "Le", "Der", "De")


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, {sql_words("regexp_replace(text, '([^\\p{L}\\p{N}_\\s''])', ' \\1 ', 'g')")} AS k FROM documents)
SELECT doc_id, array_to_string(list_transform(k, lambda w, i: CASE
  WHEN w IN {_list(STAND_IN_NAMES)} THEN 'someone'
  WHEN i > 1 AND k[i - 1] IN {_list(STAND_IN_NAMES)} AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}+$') THEN 'someone'
  ELSE w END), ' ') AS text FROM t""")
def mask_names(spark, d):
    return _step(spark, d, lambda c: names.mask_names(c, STAND_IN_NAMES))


# Title-case words that open a turn of a conversation stand in for a lexicon: a table that grows with the data.
LEXICON_SQL = f"""WITH lex AS MATERIALIZED (SELECT list(DISTINCT regexp_extract(text, '^[A-Z][a-z]+')) AS names FROM conversations),
t AS MATERIALIZED (SELECT doc_id, {sql_words("regexp_replace(text, '([^\\p{L}\\p{N}_\\s''])', ' \\1 ', 'g')")} AS k FROM documents)
SELECT doc_id, array_to_string(list_transform(k, lambda w, i: CASE WHEN w <> '' AND list_contains(names, w) THEN 'someone'
  WHEN i > 1 AND list_contains(names, k[i - 1]) AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}+$') THEN 'someone' ELSE w END), ' ') AS text FROM t, lex"""


def _lexicon(spark, d):
    return table(spark, d, "conversations").select(F.nullif(F.regexp_extract("text", "^[A-Z][a-z]+", 0), F.lit("")).alias("name"))


@query(LEXICON_SQL)
def mask_names_by_table(spark, d):
    return names.mask_names_by(table(spark, d, "documents").select("doc_id", "text"), _lexicon(spark, d), id_col="doc_id")


@query(LEXICON_SQL)
def mask_names_by_join(spark, d):
    """The form for lexicons too large to be sent."""
    return names.mask_names_by(table(spark, d, "documents").select("doc_id", "text"), _lexicon(spark, d), id_col="doc_id", sent=0)


NOISE_SQL = f"""noise AS (
  SELECT *, length(text) < 5 AS too_short, n < 2 AS too_few_words,
    regexp_matches(text, '^\\d+$') AS only_numbers, regexp_matches(text, '^[^a-zA-Z0-9]+$') AS only_symbols,
    n > 10 AND u::DOUBLE / greatest(n, 1) < 0.2 AS spam
  FROM (SELECT *, len(w) AS n, len(list_distinct(w)) AS u FROM (SELECT *, {sql_words('text')} AS w FROM {{src}})))"""
ANY_NOISE = "(too_short OR too_few_words OR only_numbers OR only_symbols OR spam)"


@query(f"""WITH {NOISE_SQL.format(src='documents')}
SELECT doc_id, too_short, too_few_words, only_numbers, only_symbols, spam, {ANY_NOISE} AS is_noise FROM noise""")
def noise_flags(spark, d):
    return noise.flag_noise(table(spark, d, "documents")).select("doc_id", *noise.RULES, "is_noise")


@query(f"""WITH {NOISE_SQL.format(src='documents')}
SELECT count(*) FILTER (too_short) AS too_short, count(*) FILTER (too_few_words) AS too_few_words,
  count(*) FILTER (only_numbers) AS only_numbers, count(*) FILTER (only_symbols) AS only_symbols,
  count(*) FILTER (spam) AS spam, count(*) FILTER ({ANY_NOISE}) AS total_removed FROM noise""")
def noise_stats(spark, d):
    return noise.noise_stats(table(spark, d, "documents"))


@query(f"WITH {NOISE_SQL.format(src='documents')} SELECT doc_id, text FROM noise WHERE NOT {ANY_NOISE}")
def noise_filter(spark, d):
    return noise.remove_noise(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {LABELLED_SQL} SELECT row_id, list_slice({sql_words('text')}, 1, 128) AS tokens FROM labelled")
def truncate_tokens(spark, d):
    return model.truncated_tokens(labelled(spark, d), "text").select("row_id", "tokens")


@query(f"SELECT doc_id AS row_id FROM documents WHERE len({sql_words('text')}) <= 300")
def word_limit(spark, d):
    return model.within_word_limit(documents(spark, d), limit=300).select("row_id")


@query(f"""SELECT row_id, CASE WHEN message IS NOT NULL THEN 'text' END AS field, message FROM (
  SELECT doc_id AS row_id, CASE WHEN text IS NULL THEN 'Field required'
    WHEN length(text) < 1 THEN 'String should have at least 1 character'
    WHEN len({sql_words('text')}) > 300 THEN 'Text has more than 300 words' END AS message FROM documents)""")
def input_quarantine(spark, d):
    return model.quarantine(documents(spark, d), word_limit=300).select("row_id", "field", "message")
