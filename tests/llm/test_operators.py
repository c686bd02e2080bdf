"""Each operator against a brute-force version on small tables with the awkward cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from labelmill.llm import (decontam, html_text, language_model, line_dedup, mixing, near_dedup, pii, quality, queries,
                           substring_dedup, url_filter)
from labelmill.llm.bytesops import hash_words
from labelmill.llm.runlength_index import RunLengthIndex
from labelmill.llm.substring_dedup import mark_chunk

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, _id string, _version int, `odd.name` string"
WORDS = "the of and to in house river stone winter light paper green table window garden mountain".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "yy"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    long_text = "\n".join(words(rng, 40) for _ in range(700))
    base = words(rng, 120)
    notice = "Please read this notice before you go on reading anything else."
    made = [(0, base), (1, base), (2, base.replace("house", "home", 1)), (3, base.upper()), (4, ""), (5, None), (6, " \n\t "), (7, "one"), (8, "one"),
            (9, "x\n" + notice + "\n" + base[:200]), (10, notice.lower() + "  \nmore\n\n" + notice), (11, long_text), (12, long_text + " end"),
            (13, "é" * 150 + " ünïcödé\n" + words(rng, 30)), (14, "a" * 400), (15, "\n".join(["same line of text here"] * 6)), (15, "\n".join(["same line of text here"] * 6))]
    made += [(20 + i, words(rng, rng.randint(3, 90))) for i in range(30)]
    made += [(60 + i, base[: 300 + 7 * i] + " " + words(rng, 6)) for i in range(12)]
    out = [(i, t, "en" if i % 3 else None, "src%d" % (i % 4) if i % 5 else None, i, "z", None, None) for i, t in made]
    return out + [(None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_id(df):
    """Rows with an id, by id (repeated rows must agree)."""
    found = {}
    for r in df.collect():
        r = r.asDict(recursive=True)
        if r["doc_id"] is not None:
            assert found.setdefault(r["doc_id"], r) == r
    return found


def test_columns_come_back(spark, docs):
    for made, gone in ((line_dedup.drop_repeated_lines(docs), ()), (pii.find_pii(docs), ()), (quality.judge_quality(docs), ("n_words",)),
                       (near_dedup.drop_near_duplicates(docs), ()), (substring_dedup.drop_repeated_substrings(docs), ("text",)),
                       (decontam.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)), ("n_words",))):
        assert {"doc_id", "lang", "source", "_id", "_version", "odd.name"} <= set(made.columns)
        assert len(set(made.columns)) == len(made.columns)
        for c in ("doc_id", "lang", "source", "_id", "_version"):
            assert made.schema[c].dataType == docs.schema[c].dataType
        assert made.count() == docs.count() or "kept" not in made.columns


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality.judge_quality(none).count() == 0
    assert substring_dedup.drop_repeated_substrings(none).count() == 0
    assert language_model.score_texts(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert decontam.find_contamination(none, docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_main_text(pages).count() == 0 and url_filter.judge_urls(pages).count() == 0


def test_line_dedup(docs, rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    got = by_id(line_dedup.drop_repeated_lines(docs))
    for i, t in texts.items():
        kept = [x for x in t.split("\n") if len(holders.get(key(x), ())) < 2 or i == min(holders[key(x)])]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept))
    three = by_id(line_dedup.drop_repeated_lines(docs, min_docs=3))
    assert three[10]["text"] == texts[10]  # only two documents hold the notice


def link(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, width):
    want = link({i: t for i, t, *_ in rows if i is not None}, width, 80)
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]] and r["kept"] == (r["id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    kept = near_dedup.drop_near_duplicates(docs, width=width).select("doc_id").distinct().collect()
    assert {r[0] for r in kept} == {i for i, (_, c) in want.items() if i == c} | {None}


def test_near_duplicates_hot_groups(spark):
    """A third of all rows are near copies of one text, another third shares its common shingles, and a chain links at the border."""
    rng = random.Random(3)
    base = words(rng, 60).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{i}"
        texts[i] = " ".join(w)
    for i in range(150, 300):
        texts[i] = " ".join(base[:12]) + " " + " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(4, 40)))
    chain = [f"c{j}" for j in range(40)]
    for i in range(300, 330):
        chain = chain[1:] + [f"d{i}"]
        texts[i] = " ".join(chain)
    df = spark.createDataFrame([(i * 7 % 1009, t) for i, t in texts.items()], "doc_id long, text string")
    want = link({i * 7 % 1009: t for i, t in texts.items()}, 2, 80)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=2).collect()}
    assert got == want


def test_near_duplicates_common_values(spark):
    """B is A without its new fifth, half of A's retained values are new, and all values they share are common."""
    def sketch(text):
        return set(near_dedup.shingle_set(text, 1)[: near_dedup.K].tolist())

    old = [f"o{i}" for i in range(160)]
    for seed in range(10**6):  # a rare draw: 15 retained values or more are new
        new = [f"n{seed}x{i}" for i in range(40)]
        values = sorted(hash_words(" ".join(old + new).encode()).view("int64").tolist())
        mine = set(hash_words(" ".join(new).encode()).view("int64").tolist())
        if sum(v in mine for v in values[: near_dedup.K]) >= 15:
            break
    a, b = " ".join(old + new), " ".join(old)
    rng, held = random.Random(1), sorted(sketch(b))
    word = {int(hash_words(w.encode()).view("int64")[0]): w for w in old}
    texts = {0: a, 1: b}
    for i in range(2, 122):  # holders of the common values, like nothing else
        texts[i] = " ".join([word[v] for v in rng.sample(held, 10)] + [f"z{i}y{j}" for j in range(30)])
    hidden = {"tested": 0}
    real = near_dedup._stars

    def blind(lists, sets, docs, width, percent):
        tested, links = real(lists, sets, docs, width, percent)
        hidden["tested"] += 1
        return tested.where("false"), links.where("false")  # stars only save work

    near_dedup._stars = blind
    try:
        got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=1).collect()}
    finally:
        near_dedup._stars = real
    assert hidden["tested"] == 1 and got == {i: c for i, (_, c) in link(texts, 1, 80).items()} and got[1] == 0


def test_near_duplicates_bounds():
    tail = lambda n, m, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m))
    for percent in (70, 80, 90):
        prefix, least = near_dedup.bounds(percent)
        assert tail(prefix, 2, percent / 100) < 1e-9 and tail(near_dedup.K, least, percent / 100) < 1e-9 and least >= 2
    with pytest.raises(ValueError):
        near_dedup.bounds(20)


def test_quality(docs, rows):
    got = by_id(quality.judge_quality(docs))
    for i, t, *_ in rows:
        if i is None:
            continue
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) for k in range(3) if grams[tuple(w[j : j + 3])] > 1}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\f\r")]
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]
        assert [got[i][c] for c in quality.BASE_COUNTS] == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_quality_divergence(spark):
    """Clean texts of a language stay; the same words with signs stuck to them, or in capitals, go."""
    rng = random.Random(9)
    clean = [(i, words(rng, 150).capitalize() + ".", "en") for i in range(60)]
    odd = [(100, " ".join(w + "%%%" for w in words(rng, 150).split()), "en"), (101, words(rng, 150).upper().replace(" ", "!! "), "en")]
    got = by_id(quality.judge_quality(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")))
    assert all(got[i]["kept"] for i, *_ in clean) and not got[100]["kept"] and not got[101]["kept"]
    kept = quality.keep_good(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 60


def test_quality_without_function_words(spark):
    """In a language with a share of 0.22, plain words without function words go; clean texts, tables and languages without a list stay."""
    rng = random.Random(4)
    plain = lambda n: [rng.choice("rain stone cloud basket meadow".split()) + "".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    prose = lambda n: " ".join(rng.choice("the of and to in a is that".split()) if rng.random() < 0.22 else w for w in plain(n)) + "."
    rows = [(i, prose(rng.choice([60, 90, 300])), "en") for i in range(200)] + [(1000 + i, " ".join(plain(90)), "pl") for i in range(20)]
    rows += [(300 + i, " ".join(plain(60 + 40 * i)) + ".", "en") for i in range(5)] + [(400 + i, " | ".join(plain(60 + 40 * i)), "en") for i in range(5)]
    got = by_id(quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not any(r["base_failed"] for r in got.values()) and max(r["word_distance"] for r in got.values()) < quality.MAX_WORD_DISTANCE
    assert [i for i, r in got.items() if not r["kept"]] == [300, 301, 302, 303, 304]


def repeated_bytes(texts, span):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - span + 1):
            if raw[j : j + span] in seen:
                gone[j : j + span] = b"\x01" * span
            seen.add(raw[j : j + span])
        out[i] = (bytes(b for b, g in zip(raw, gone) if not g), sum(gone), len(re.findall(b"\x01+", bytes(gone))))
    return out


@pytest.mark.parametrize("bound", [8192, 3])
def test_substring_dedup(docs, rows, monkeypatch, bound):
    monkeypatch.setattr(substring_dedup, "BOUND", bound)  # 3: nearly all goes the way of large groups
    want = repeated_bytes({i: t for i, t, *_ in [(-1, rows[0][1]), *rows] if i is not None}, 100)
    got = by_id(substring_dedup.drop_repeated_substrings(docs.where("doc_id IS NOT NULL").union(
        docs.where("doc_id = 0").withColumn("doc_id", F.lit(-1).cast("long")))))
    for i, (kept, gone, spans) in want.items():
        assert (bytes(got[i]["kept_bytes"]), got[i]["n_removed"], got[i]["n_spans"]) == (kept, gone, spans), i


def test_substring_dedup_long_texts(spark, monkeypatch):
    """Texts longer than a piece, and joins that fall back to shuffles."""
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    parts = [words(rng, 30) for _ in range(8)]
    texts = {i: " ".join(rng.choice(parts) for _ in range(12)) for i in range(6)} | {9: "ab" * 900}
    got = by_id(substring_dedup.drop_repeated_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    for i, (kept, gone, spans) in repeated_bytes(texts, 100).items():
        assert (bytes(got[i]["kept_bytes"]), got[i]["n_removed"], got[i]["n_spans"]) == (kept, gone, spans)


def test_runlength_index():
    rng = random.Random(1)
    pool = [bytes(rng.choices(b"ab", k=40)) for _ in range(5)]
    for _ in range(20):
        strings = [b"".join(rng.choice(pool)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        ids = __import__("numpy").arange(len(strings))
        batch = mark_chunk(ids, ids * 0, ids * 0, strings, 20)
        got = {i: set() for i in range(len(strings))}
        for i, a, b in zip(*(batch[c].to_pylist() for c in ("_id", "_from", "_to"))):
            got[i] |= set(range(a, b))
        seen = set()
        for i, s in enumerate(strings):
            want = set()
            for j in range(len(s) - 19):
                if s[j : j + 20] in seen:
                    want |= set(range(j, j + 20))
                seen.add(s[j : j + 20])
            assert got[i] == want
        index = RunLengthIndex(strings, 20)
        assert all(index.locate(r) == index.first_row[r] for r in range(index.size))
        assert len(index.heads) <= index.size and len(index.samples) == len(index.heads)


def test_contamination(spark, docs, rows):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    rng = random.Random(8)
    base = rows[0][1].split()
    items = [(0, " ".join(base[10:40])), (1, " ".join(base[30:45]).upper()), (2, "one"), (3, "The House, of!"), (4, ""), (5, None), (None, "same line of"), (6, words(rng, 30))]
    got = by_id(decontam.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    wins = {(n, tuple(w[s : s + n]), "null" if i is None else str(i)) for i, t in items if (w := split(t)) for n in [min(13, len(w))] for s in range(len(w) - n + 1)}
    for i, t, *_ in rows:
        if i is None:
            continue
        w, hit, named = split(t), set(), set()
        for n, win, item in wins:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == win:
                    hit |= set(range(s, s + n))
                    named.add(item)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (len(w), len(hit), sorted(named), len(named)), i
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_contamination_by_shuffle(spark, docs, monkeypatch):
    items = docs.where("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")
    near = by_id(decontam.find_contamination(docs, items))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert by_id(decontam.find_contamination(docs, items)) == near


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = ["", "mail a.b@c.de, x@y, q@r.s-t%u@v.w and 1.2.3.4 or 001.2.3.0255 or 1.2.3.999 or 1.2.3.4.5.6.7.8", "a@b.c-d%e@f.gh @ @@ a@@b.c",
             "4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123452", "+1 (743) 555-3824 +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "\U0001f600 é +49 30 1234567 e@f.gh",
             "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" b44e15e09fd311c3cf3163b66d5a9875b883d8ce',
             "9" * 30000, "a" * 60000 + "@", "1.2" * 5000]


def test_pii_many_matches(spark):
    """Time does not grow with the square of the matches in one text; offsets are those of each address."""
    texts = {n: " ".join(f"u{i}@ex{i % 7}.org" for i in range(n)) for n in (1, 2, 3, 10, 1000, 32000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("_done", F.lit("kept"))
    started = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert time.perf_counter() - started < 40
    for n, text in texts.items():
        spans = [s for s in got[n]["pii"] if s["kind"] == "email"]
        assert len(spans) == n and all(text[s["start"] : s["end"]] == s["value"] == f"u{i}@ex{i % 7}.org" for i, s in enumerate(spans))
    clean = pii.redact(pii.find_pii(df.where("doc_id = 3"))).first()
    assert (clean["text"], clean["_done"]) == ("[EMAIL] [EMAIL] [EMAIL]", "kept")


def test_pii(spark):
    rng = random.Random(4)
    texts = PII_TEXTS + ["".join(rng.choice("ab1 2.+-@(4)") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, text in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["pii"] if s["kind"] in pii.BASE] == base_spans(text), text[:80]
        assert all(s["value"] == text[s["start"] : s["end"]] for s in got[i]["pii"])
    assert got[len(texts)]["pii"] == []
    assert [s["value"] for s in got[6]["pii"] if s["kind"] == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert [s["start"] for s in got[7]["pii"] if s["kind"] == "secret"] == [9]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(df)).collect()}
    assert clean[5] == "\U0001f600 é [PHONE] [EMAIL]"


def test_mixing(docs, rows):
    got = mixing.mix(docs, shards=4).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(tokens(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert len(r["shards"]) == (0 if not r["taken"] else 1 if r["taken"] <= r["size"] and len(r["shards"]) == 1 else 2) and all(0 <= s < 4 for s in r["shards"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7), shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_takes_texts(docs, rows):
    plan = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix(docs).where("doc_id IS NOT NULL AND doc_id <> 15").collect()}
    taken = collections.Counter()
    for r in mixing.take(docs).where("doc_id IS NOT NULL AND doc_id <> 15").collect():
        whole = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert whole.startswith(r["text"])
        taken[r["doc_id"]] += len(tokens(r["text"]))
    assert all(taken[i] == n for (i, _, _), n in plan.items())


def test_split_quotas(spark):
    """Every source's quota is split whole, shards are equally full, and draws follow the distribution."""
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 3), ("c", 0)], "source string, quota long")
    got = mixing.split_quotas(quotas, 8).collect()
    per_source, per_shard = collections.Counter(), collections.Counter()
    for r in got:
        per_source[r["source"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
        assert r["quota"] >= 0
    assert per_source == {"a": 100, "b": 37, None: 3, "c": 0} and max(per_shard.values()) - min(per_shard.values()) <= 1
    draws = [mixing.split_quotas(quotas, 2, seed).where("shard = 0 AND source = 'b'").first()["quota"] for seed in range(30)]
    assert 16 < sum(draws) / 30 < 21 and len(set(draws)) > 3


def test_language_model(docs, rows):
    got = language_model.score_texts(docs, state_share=0.005, block_tokens=500, range_tokens=300).collect()
    assert len(got) == len(rows)
    texts = [(i, tokens(t) + [None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in texts:
        if not held(i):
            c.update(w)
            pairs.update(zip([None] + w, w))
    total, kinds = sum(c.values()), len(c)
    single = lambda w: (c[w] + 0.5) / (total + 0.5 * (kinds + 1))
    state = lambda w: w is None or c[w] >= max(1, 0.005 * total)
    arcs = {k: (n - 0.75) / c[k[0]] for k, n in pairs.items() if n >= 2 and state(k[0]) and state(k[1])}
    failure = {h: (1 - sum(p for (a, _), p in arcs.items() if a == h)) / (1 - sum(single(w) for a, w in arcs if a == h)) for h in c if state(h)}
    want = collections.Counter()
    for i, w in texts:
        score, h = 0.0, None
        for x in w:
            score += math.log10(arcs[h, x] if (h, x) in arcs else single(x) * (failure[h] if state(h) else 1))
            h = x
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10(single(x)) for x in w), 6), round(score, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    # A state's arcs and its failure arc add up to one.
    h = "the"
    on_arcs = {w for a, w in arcs if a == h}
    rest = sum(single(w) for w in c if w not in on_arcs) + 0.5 / (total + 0.5 * (kinds + 1))
    assert math.isclose(sum(arcs[h, w] for w in on_arcs) + failure[h] * rest, 1, rel_tol=1e-9)


def test_language_model_likes_its_language(spark):
    rng = random.Random(6)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text():
        w = [rng.choice(WORDS)]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    r = language_model.score_texts(df, state_share=0.002).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.6 * r[1]  # held-out texts are far more probable with pairs


def test_language_model_rare_pairs(spark):
    """A pair of rare words (far below 1/10,000 of all tokens) is an arc as soon as it was seen twice."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train, out = [i for i in range(200) if not held(i)], [i for i in range(200) if held(i)]
    texts = {i: "the " * 600 for i in range(200)}
    texts |= {train[0]: "salt quartz", train[1]: "salt quartz", out[0]: "salt quartz", out[1]: "quartz salt"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(df).collect()}
    gain = lambda i: got[i]["score"] - got[i]["base_score"]
    assert got[out[0]]["train_tokens"] > 20_000 * 4 and gain(out[0]) > gain(out[1]) + 6
    # Three arcs: boundary to salt, salt to quartz, quartz to boundary.
    n, c = len(train), got[out[0]]["train_tokens"]
    single = lambda k: (k + 0.5) / (c + 0.5 * 5)  # noqa: E731 - four kinds: the, salt, quartz, the end
    want = math.log10(1.25 / n / single(2)) + math.log10(1.25 / 2 / single(2)) + math.log10(1.25 / 2 / single(n))
    assert math.isclose(gain(out[0]), want, abs_tol=1e-6)


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Home of all things</a></li></ul></nav><div class="cookie-notice">We use cookies and more.</div><!-- <p>no</p> -->
    <article><h1>Head &amp; &#x20ac; line</h1><p>First   <b>bold<br>text</b>\n of the article.<p>Second with <a href=x>a link</a> in it, and more to read.
    <form><p>Name <input></p></form><div id="comments"><p>Reader says hi to the rest of us.</p></div><ul><li>point one</li><li>point two</li></ul>
    <ul class=related><li><a href=y>Other story</a></li></ul><p>x</p></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & \u20ac line\nFirst bold text of the article.\nSecond with a link in it, and more to read.\npoint one\npoint two\nx"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><p>cut off in the <b>middle of a tag <a href='x") .startswith("cut off in the middle")
    prose = "This is the story of a house by the river and of the people that lived in it for a long time, as it was told to me. " * 3
    assert html_text.main_text(f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h2>Story</h2><div>{prose}</div><p>The end.</p><div>{prose}</div></div><div>\xa9 2020 me</div>") \
        == "\n".join(["Story", prose.strip(), "The end.", prose.strip()])


def test_html_home_by_text():
    """The element that holds the text is its home, not a card; languages without a word list have a main text too."""
    prose = "This is the story of a house by the river and of the people that lived in it for a long time, as it was told to me. " * 3
    cards = "".join(f"<article><h3>Card {i}</h3><p>More of this in our next issue.</p></article>" for i in range(4))
    for name in ("main", "div"):
        for page in (f"<{name}><h2>Story</h2><p>{prose}</p><p>{prose}</p></{name}>{cards}", f"<{name}><h2>Story</h2><p>{prose}</p><p>{prose}</p>{cards}</{name}>"):
            assert html_text.main_text(page).startswith("\n".join(["Story", prose.strip(), prose.strip()])), page
    other = "Pewnego dnia stary rybak znalaz\u0142 nad brzegiem jeziora kamie\u0144, kt\u00f3ry \u015bwieci\u0142 w ciemno\u015bci jak ma\u0142a gwiazda. "
    assert html_text.main_text(f"<p>{other * 3}</p><ul><li><a href=a>{other}</a></li></ul><p>{other * 2}</p>") == (other * 3).strip() + "\n" + (other * 2).strip()
    assert html_text.main_text(f"<div><p>{other}</p><p>{other}</p></div>") == "\n".join([other.strip()] * 2)
    assert html_text.main_text(f"<p>{prose}</p><p>{other * 2}</p><p>{prose}</p>").count("rybak") == 2
    linked = "It is said in <a href=a>the book of the long river and of the old house</a> that this was on the way to the town of the king. "
    assert html_text.main_text(f"<p>{linked * 3}</p>").count("book") == 3


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "the of and to in a is that it was for on are as with. " * 9 + "</p>", "x", 3), (None, None, None, None, None), (1, "u", "<a>" * 5000, "x", 3)],
                               "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract_main_text(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len("the of and to in a is that it was for on are as with. " * 9) - 1]


def test_url_parts_and_rules(spark):
    urls = [None, "", "no-scheme/a", "http://A.Example.ORG/en/12?x#y", "https://example.org", "x://example.org:80/es/", "https://b.com/fr/1", "https://com/de/2", "http://xcom/de/", "https://q.net/a?b",
            "http://notexample.org/es/", "http://example.org/es/1", "http://u@h.org#f"]
    df = spark.createDataFrame([(i, u, "<title>river stone house</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fits)[1] if fits else None)
        assert got[i]["verdict"] == max(fits)[2] if fits else got[i]["verdict"] in ("allow", "block")


def test_viterbi_and_bayes(spark):
    counts = {"river": 50, "stone": 40, "house": 30, "ri": 2, "versto": 1}
    label = "riverstonehouse"
    known = {(s, s + len(w)): n for w, n in counts.items() for s in range(len(label)) if label[s : s + len(w)] == w}
    assert url_filter.viterbi(label, known, 123) == ["river", "stone", "house"]
    assert "".join(url_filter.viterbi("qzqz", {}, 10)) == "qzqz" and url_filter.viterbi("", {}, 1) == []
    rules = (("good.org", "/", "allow"), ("bad.org", "/", "block"))
    rows = [(i, f"http://{'sunny' if i % 2 else 'gloomy'}{'garden' if i % 3 else 'house'}.{'good' if i % 2 else 'bad'}.org/{'read' if i % 2 else 'spam'}/{i}", "<title>sunny gloomy garden house</title>") for i in range(40)]
    rows += [(100, "http://sunnyhouse.net/read/7", ""), (101, "http://gloomygarden.net/spam/7", "")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=rules).collect()}
    assert got[100]["verdict"] == "allow" and got[101]["verdict"] == "block" and got[100]["host_words"][:2] == ["sunny", "house"]


def test_url_words_of_bodies(spark):
    """Host words are learnt from whole pages, in all letters: bodies count, scripts and tags do not."""
    html = "<html><head><title>Start</title><script>var moonlight = 1</script></head><body><p class='lantern'>Gr\u00f6\u00dfe gl\u00fcck &amp; S\u00fcden.</p><p>forest <b>canyon</b></p></body></html>"
    df = spark.createDataFrame([(i, f"http://{h}.net/", html) for i, h in enumerate(["forestcanyon", "gr\u00f6\u00dfegl\u00fcck"])] + [(9, None, None)], "page_id long, url string, html string")
    counts = {r["word"]: r["n"] for r in url_filter.page_words(df, "html").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert counts == {w: 2 for w in ("start", "gr\u00f6\u00dfe", "gl\u00fcck", "s\u00fcden", "forest", "canyon")}
    got = {r["page_id"]: r["host_words"] for r in url_filter.judge_urls(df).collect()}
    assert got[0][:2] == ["forest", "canyon"] and got[1][:2] == ["gr\u00f6\u00dfe", "gl\u00fcck"]


def test_word_hashes():
    text = "\x1c a\u00a0b \x85 ÀB\x0bc\r\n" + "w" * 700000 + " end"
    assert len(hash_words(text.encode())) == len(text.encode().split())
    many = [f"w{i}" for i in range(20000)]
    assert len(set(hash_words(" ".join(many).encode()).tolist())) == 20000
    assert hash_words(b"x yy x")[0] == hash_words(b"\n\n zz x")[1]


def test_registered():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.SQL) <= set(names)
    assert hashlib.sha256(b"").hexdigest()


def test_decontamination_counts_words_by_splitting(spark):
    texts = ["", " ", "a", " One two,THREE-4 ", "żółć Ärger 漢字\U0001F600x!y", None, "[Z]^z`Q", "\x7fa\x00b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = decontam.find_contamination(df, items)
    got = {r["doc_id"]: r["n_words"] for r in out.collect()}
    assert got == {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan  # a search is six times as slow as a split
