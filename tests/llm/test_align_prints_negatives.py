"""Token alignment, spot-signature fingerprints and hard negatives against brute force, with the awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import hard_negatives, spotsigs, token_align

USE = token_align.load()


def tokens(text):
    """Tokens of a whole text at once, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = USE.a.encode(" " + text, add_special_tokens=False).ids, USE.b.encode(text)
    spelled = b"".join(USE.bytes_a[i] for i in a) == raw and b"".join(USE.bytes_b[i] for i in b) == raw
    return (a, b) if spelled else None


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def groups(a, b):
    out, x, y, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a, i = at_a + len(USE.bytes_a[a[i]]), i + 1
            x.append(a[i - 1])
        else:
            at_b, j = at_b + len(USE.bytes_b[b[j]]), j + 1
            y.append(b[j - 1])
        if at_a == at_b:
            out.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            x, y = [], []
    return out


ALPHABET = "  \t\n 　▁᠎​\x00\x1f\x85ab'sé²ñ漢字😀1<s>|endoftext́"
TEXTS = [None, "", " ", "  ", "a ", "  a  b ", "the house", "the house", "aa aaa aaaa", "<|endoftext|> <s> </s>", "don't we'll", "été œuvre ß", "x" * 3000, "\n\n\t"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    plain = [" ".join(rng.choice("the house of winter Straße naïve running 2024 antidisestablishment".split()) + rng.choice(["", "", ",", "er"])
                      for _ in range(rng.randint(1, 80))) for _ in range(80)]
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return TEXTS + plain + odd


def test_words_give_the_tokens_of_whole_texts(texts):
    for text in texts:
        if text:
            words = token_align._Words(token_align.CUT.split(" " + text), USE)
            whole = tokens(text)
            assert words.bad.any() == (whole is None)
            assert whole is None or "".join(words.said)[:-1] == ";".join(groups(*whole))


@pytest.mark.parametrize("block_chars", [16_000_000, 500])
def test_alignment(spark, texts, block_chars):
    rows = [(None if i == 20 else i - i % 2, t, "x", "y") for i, t in enumerate(texts)]  # ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, id string").repartition(3)
    links = {}
    for t in set(texts):
        if tokens(t):
            a, b = (spans(ids, table) for ids, table in zip(tokens(t), (USE.bytes_a, USE.bytes_b)))
            links[t] = [(i, j) for s, e, i in a for u, v, j in b if s < v and u < e]
    docs = collections.Counter(p for t in texts if t in links for p in set(links[t]))
    most = collections.Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)

    def expected(t):
        if t not in links:
            return 0, 0, 0, 0, 0, 0, ""
        said = groups(*tokens(t))
        return (*map(len, tokens(t)), len(said), len(links[t]), sum(docs[p] == most[p[0]] for p in links[t]), sum(docs[p] for p in links[t]),
                hashlib.sha256(";".join(said).encode()).hexdigest())

    got = token_align.align_tokens(df, block_chars=block_chars)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((i, *expected(t)) for i, t, *_ in rows)
    if block_chars == 500:
        pairs = {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in token_align.id_pairs(df, block_chars=block_chars).collect()}
        assert pairs == {p: (n, n == most[p[0]]) for p, n in docs.items()}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align_tokens(docs).count() == 0 and token_align.id_pairs(docs).count() == 0
    assert spotsigs.fingerprint_edits(docs).count() == 0
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 900])
def test_fingerprints(spark, bucket_bytes):
    rng = random.Random(2)
    some = "the of and house river stone winter Light paper, green. table x y the the of".split()
    rows = [(i * 3, " ".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(5, None), (5, "the house"), (5, "the house"), (None, "of light x"), (None, None), (7, ""), (8, "é漢字😀 the stone of y"), (10**12, "zz zz"),
             (-(2**63), "the the"), (2**63 - 1, "long " * 9000)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, bucket string, id string")
    hashes = {(r.doc_id, r.t): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r]))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    count = collections.Counter(w for _, t in order for w in words(t))
    anchors = {w for w, n in count.items() if n * 8 >= count.total()}
    assert sorted(anchors) == spotsigs.anchors_of(df, share=8)

    def signatures(t):
        content = [(w, words(t)[i - 1] if i else None) for i, w in enumerate(words(t)) if w not in anchors]
        found = {(before, w, *[x for x, _ in content[i + 1: i + 2]]) for i, (w, before) in enumerate(content) if before in anchors}
        return found or ({tuple(words(t))} if words(t) else set())

    expected = collections.Counter()
    for k, (i, t) in enumerate(order):
        follows, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        s, e, n = signatures(t), signatures(edited), signatures(follows)
        expected[i, len(t), edited, len(s), len(e), round(jaccard(s, e), 9), round(jaccard(s, n), 9)] += 1
    got = spotsigs.fingerprint_edits(df, share=8, bucket_bytes=bucket_bytes).collect()
    assert collections.Counter((r.id, r.n_chars, r.edited, len(r.fingerprint), len(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected
    same = {}
    for r in got:
        for text, prints in ((r.edited, r.edited_fingerprint),):
            assert same.setdefault(text, prints) == prints


def reachable(sets, percent):
    """The root of each set by brute force over all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_partitions_by_length_hold_all_links():
    for percent in (50, 70, 75, 80, 90, 100):
        starts = spotsigs.length_parts(400, percent)
        part = [sum(s <= n for s in starts) for n in range(401)]
        assert all(part[m] - part[n] in (0, 1) for n in range(1, 401) for m in range(n, 401) if 100 * n >= percent * m)


@pytest.mark.parametrize("percent, list_rows", [(80, 7), (60, 2000)])
def test_similar_documents(spark, percent, list_rows):
    rng = random.Random(percent)
    some = ["the", "of", "and"] * 15 + [f"c{i}" for i in range(60)]
    plain = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    base = " ".join(rng.choice(some) for _ in range(300)).split()
    family = []
    for i in range(90):  # a chain of near copies, in which far ones are linked over others only
        base = list(base)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = f"w{rng.randrange(30)}"
        family.append(" ".join(base))
    texts = plain + family + [plain[3], plain[3], family[5], None, "", None, "...", "zz zz", "zz zz"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids = [None if i == 17 else i // 2 if i < 20 else i for i in ids]  # some ids repeat
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, k string, sigs string").repartition(5)
    prints = df.select("doc_id", "text", spotsigs.signatures(F.coalesce("text", F.lit("")), spotsigs.anchors_of(df, share=12)).alias("s")).collect()
    sets, least = [frozenset(r.s) for r in prints], lambda found: min((i for i in found if i is not None), default=None)
    roots = reachable(sets, percent)
    want = collections.Counter()
    for i, r in enumerate(prints):
        own = [p.doc_id for p, s in zip(prints, sets) if s == sets[i]] if sets[i] else [r.doc_id]
        group = [p.doc_id for p, root in zip(prints, roots) if root == roots[i]] if sets[i] else [r.doc_id]
        want[r.doc_id, least(own), least(group)] += 1
    got = spotsigs.similar_documents(df, percent=percent, share=12, list_rows=list_rows)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert len(set(roots)) < len(set(sets)) - 20  # there are links between different sets


def test_similar_documents_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spotsigs.similar_documents(none).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "- -")], "doc_id long, text string")
    assert sorted(map(str, spotsigs.similar_documents(blank).collect())) == [
        "Row(id=1, set_id=1, group_id=1)", "Row(id=2, set_id=2, group_id=2)", "Row(id=None, set_id=None, group_id=None)"]


def test_anchors_are_bounded(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 50}" for i in range(5000)))], "doc_id long, text string")
    assert len(spotsigs.anchors_of(docs, share=50)) == 50 and spotsigs.anchors_of(docs, share=49) == []


def brute_negatives(rows, anchor):
    held = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [float(np.floor(256 * float(np.float32(x)))) for x in v]
            held[i] = min(held.get(i, (label, v)), (label, v))
    score = lambda x, y: int(sum(a * b for a, b in zip(x, y)))
    out = set()
    for a, (label, v) in held.items():
        if anchor(a):
            ranked = sorted((-score(v, w), i) for i, (_, w) in held.items() if i != a)
            for p, i in [r for r in ranked if held[r[1]][0] == label][:5]:
                fit = [(q, j) for q, j in ranked if held[j][0] != label and 50 * -p <= 100 * -q <= 95 * -p][:3]
                out |= {(a, i, k + 1, j, -p, -q) for k, (q, j) in enumerate(fit)}
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in rng.permutation(700)[:400]]
    close = [0.5, 0.5, 0.1, 0.0, 0.0, 0.2]
    rows += [(1000 + i, [x + 0.001 * (i % 40) for x in close], i % 2) for i in range(150)]  # a large group of near copies
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 0), (2004, close, None), (None, close, 1),
             (2005, [], 1), (2006, [1.0, 1.0], 1), (2007, close, 2), (2007, close, 1), (2007, close, 1), (2050, [0.0] * 6, 2), (2100, [-3.0] * 6, 7), (2150, [9.0] * 6, 8)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, label int, pivot string, id int").repartition(5)
    got = hard_negatives.mine_hard_negatives(df, anchors=F.col("id") % 50 == 0, pivots=4, block_rows=60).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_cover_tree_covers():
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(size=(500, 4)), np.zeros((300, 4)), rng.normal(size=(1, 4)) * 1000])
    tree = hard_negatives.CoverTree(rows)
    assert sorted(tree.order) == list(range(len(rows)))
    for centres, radii, spans in tree.levels:
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]]
        for c, r, (a, b) in zip(centres, radii, spans):
            assert np.sqrt(((rows[tree.order[a:b]] - rows[c]) ** 2).sum(1)).max() <= r + 1e-9
