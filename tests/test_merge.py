import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import merge, neardup, noise
from labelmill.operators.dedup import duplicate_count, keep_first


def test_noise_rules(spark):
    texts = ["abc", "oneword", "12345", "?!?!?!", " ".join(["spam"] * 11), "a good sentence", None, "привет мир"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hits = [[r for r in noise.RULES if row[r]] for row in noise.flag_noise(df).collect()]
    assert hits == [["too_short", "too_few_words"], ["too_few_words"], ["too_few_words", "only_numbers"],
                    ["too_few_words", "only_symbols"], ["spam"], [], [], ["only_symbols"]]
    assert noise.noise_stats(df).first()["total_removed"] == 7
    assert [r["text"] for r in noise.remove_noise(df, unicode=True).collect()] == ["a good sentence", texts[-1]]


LABELS = {"a": [0, 0, 2], "b": [0, 1], "c": [0, 0, 1, 1, 2], "d": [1, 1, 0, 0], "e": [2, 2, 1], "f": [1], "g": [0, 0]}


@pytest.fixture(scope="module")
def conflicting(spark):
    rows, i = [], 0
    for key, labels in LABELS.items():
        for label in labels:
            rows.append((i, key, label, "xy"[i % 2]))
            i += 1
    return spark.createDataFrame(rows, "row_id long, canonical_text string, label int, source string")


@pytest.mark.parametrize(
    ("strategy", "expected"),
    [
        ("majority_vote", {"a": 0, "b": 1, "c": 2, "d": 1, "e": 2, "f": 1, "g": 0}),
        ("severity_priority", {"a": 2, "b": 1, "c": 2, "d": 1, "e": 2, "f": 1, "g": 0}),
        ("remove", {"f": 1, "g": 0}),
    ],
)
def test_one_row_per_key_survives(conflicting, strategy, expected):
    out = merge.resolve_and_dedup(conflicting, strategy).collect()
    assert {r["text"]: r["label"] for r in out} == expected and len(out) == len(expected)
    sources = {r["text"]: r["source"] for r in out}
    assert sources["f"] in "xy" and (strategy == "remove" or sources["a"] == "x|y")


def test_audit_and_partition(conflicting):
    audit = {r["text"]: r for r in merge.conflict_audit(conflicting).collect()}
    assert set(audit) == set("abcde") and audit["c"]["original_labels"] == {0: 2, 1: 2, 2: 1}
    agreed, disputed = merge.split_conflicts(conflicting, "canonical_text")
    assert agreed.count() + disputed.count() == conflicting.count() and agreed.count() == 3
    assert merge.drop_conflicts(conflicting, "canonical_text").count() == 3
    first = merge.conflict_report(merge.conflict_audit(conflicting)).first()
    assert (first["text"], first["label_frequencies"], first["resolved_label"]) == ("a", "class 0: 2 times, class 2: 1 times", "class 0")
    with pytest.raises(ValueError):
        merge.resolve_and_dedup(conflicting, "other")


def test_dedup_of_a_hot_key(spark):
    df = spark.range(9000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    kept = keep_first(df, F.col("t"))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()
    assert kept.count() == 6001 and kept.filter("t = 'hot'").first()["row_id"] == 0
    assert duplicate_count(df, F.col("t")).first()["duplicates"] == 2999


def test_union_keeps_source_order(spark):
    a = spark.createDataFrame([(5, "a")], "row_id long, text string")
    b = spark.createDataFrame([(1, "b")], "row_id long, text string")
    assert [r["text"] for r in merge.unite([a, b]).orderBy("row_id").collect()] == ["a", "b"]


def test_union_of_many_partitions(spark):
    """Ids of two sources of 200 partitions each stay apart, and an id out of range is an error."""
    one = spark.range(0, 1000, 1, 200).select(F.monotonically_increasing_id().alias("row_id"), F.col("id").cast("string").alias("text"))
    both = merge.unite([one, one])
    assert both.select("row_id").distinct().count() == both.count() == 2000
    gone = both.filter(F.col("row_id") >= 1 << 56).limit(5).select("row_id")
    assert both.join(gone, "row_id", "left_anti").count() == 1995
    with pytest.raises(Exception, match="must be below"):
        merge.unite([one.withColumn("row_id", F.lit(1 << 56))]).collect()


# ---------------------------------------------------------------- near-duplicates


def greedy(rows, t):
    """Brute force: a row goes if an earlier kept row is similar."""
    kept, gone = [], set()
    for i, text in rows:
        s = set(text.split())
        if not s:
            continue
        if any(len(s & k) / len(s | k) >= t for k in kept):
            gone.add(i)
        else:
            kept.append(s)
    return gone


def corpus(seed, n, vocabulary, lengths, copies=0.5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < copies:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(vocabulary)}"
            rng.shuffle(words)
        else:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice(lengths))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(
    ("seed", "vocabulary", "lengths", "threshold", "limit"),
    [
        (1, 400, (10, 20, 30), 0.9, 64),
        (2, 30, (8, 12, 20), 0.8, 3),  # large groups: splitting and rounds
        (3, 12, (3, 5, 6), 0.6, 2),
        (4, 8, (1, 2, 3), 0.5, 2),  # may share a single word only
    ],
)
def test_greedy_rule_equals_brute_force(spark, seed, vocabulary, lengths, threshold, limit):
    rows = corpus(seed, 250, vocabulary, lengths)
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = neardup.removed_by(df, threshold=threshold, group_limit=limit).collect()
    expected = greedy(rows, threshold)
    assert {r["id"] for r in out} == expected and len(out) == len(expected)
    texts = dict(rows)
    for r in out:  # the named row was kept and is similar
        a, b = set(texts[r["id"]].split()), set(texts[r["kept"]].split())
        assert r["kept"] not in expected and len(a & b) / len(a | b) >= threshold


def test_cluster_of_a_third_of_all_rows(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(i, " ".join(base[:19] + [f"x{i}"])) for i in range(300)] + [(1000 + i, f"u{i} v{i} z{i} y") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = neardup.removed_by(df, threshold=0.9, group_limit=8).collect()
    assert {r["id"] for r in out} == set(range(1, 300)) and {r["kept"] for r in out} == {0}


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, " "), (4, " ")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert [r["id"] for r in neardup.removed_by(df).collect()] == [2]  # similarity is exactly 0.9
    a = [f"a{i}" for i in range(20)]
    chain = [(1, " ".join(a)), (2, " ".join(a[1:])), (3, " ".join(a[2:]))]  # (1,2) and (2,3) are similar, (1,3) at 0.9 too
    chain_df = spark.createDataFrame(chain, "row_id long, text string")
    assert sorted(r["row_id"] for r in neardup.drop_near_duplicates(chain_df, threshold=0.93).collect()) == [1, 3]


def test_merge_statistics(spark):
    rows = [(1, "One good text", 0), (2, "one good text ", 1), (3, "bad", 0), (4, "another fine text", 2), (5, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    none = df.limit(0).select("row_id")
    got = merge.merge_statistics(df, none).first().asDict()
    assert got["total_merged_input"] == 5 and got["total_removed"] == 2 and got["exact_and_canonical_duplicates_removed"] == 1
    assert got["conflicts_detected"] == 1 and got["total_output_rows"] == 2


@pytest.mark.parametrize("most", [neardup.SETTLE_PAIRS, 40, 3])
def test_settling_equals_the_rule(spark, most):
    """All pairs in one task, components dealt into tasks, and rounds for components that are too large for one."""
    rng = random.Random(most)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(100 + i, 101 + i) for i in range(30)} | {(200, 201), (200, 202), (201, 202)}
    kept, gone = set(), {}
    for i in range(300):
        partners = sorted(a for a, b in pairs if b == i and a in kept)
        if partners:
            gone[i] = partners[0]
        else:
            kept.add(i)
    df = spark.createDataFrame([(a, b, a / 100) for a, b in sorted(pairs)], "a long, b long, similarity double")
    got = {r["id"]: (r["kept"], r["similarity"]) for r in neardup.settle(df, most).collect()}
    assert got == {b: (a, a / 100) for b, a in gone.items()}
    assert neardup.settle(df.limit(0), most).count() == 0


@pytest.fixture
def written(monkeypatch):
    """The rows of each intermediate table, by name."""
    tables, real = [], neardup.materialize

    def watched(df, name):
        made = real(df, name)
        tables.append((name, made.count()))
        return made

    monkeypatch.setattr(neardup, "materialize", watched)
    return tables


def test_chain_needs_few_writes(spark, written):
    chain = spark.createDataFrame([(i, i + 1, 0.95) for i in range(200)], "a long, b long, similarity double")
    assert sorted(r["id"] for r in neardup.settle(chain).collect()) == list(range(1, 201, 2))
    assert len(written) == 0
    two = chain.union(chain.selectExpr("a + 1000", "b + 1000", "similarity"))
    assert neardup.settle(two, 250).count() == 200 and len(written) <= 12


def test_clusters_and_dissimilar_rows_that_share_words(spark, written):
    """Near copies and unlike texts with three words in common: large groups, but the pairs written grow with the rows."""
    def made(n, threshold, own):
        rows = [(i, "u v w " + " ".join(f"x{i}y{j}" for j in range(own[i % len(own)]))) for i in range(n)]
        out = neardup.removed_by(spark.createDataFrame(rows, "row_id long, text string"), threshold=threshold, group_limit=16).collect()
        assert {r["id"] for r in out} == {i for i in range(1, n) if own[i % len(own)] == 1}  # near copies of row 0
        total = sum(rows for name, rows in written if name in ("candidates", "pairs"))
        assert max(rows for _, rows in written) <= 40 * n
        written.clear()
        return total

    assert made(1200, 0.5, (1, 9)) <= 5 * made(300, 0.5, (1, 9))
    assert made(4000, 0.8, (17,)) <= 4000


def test_bitmaps_bound_the_difference(spark):
    rng = random.Random(9)
    rows = [(sorted(rng.sample(range(-10**6, 10**6), rng.randint(0, 90))), sorted(rng.sample(range(-10**6, 10**6), rng.randint(0, 90)))) for _ in range(50)]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>").select("x", "y", F.array(*neardup.bitmap(F.col("x"))).alias("p"), F.array(*neardup.bitmap(F.col("y"))).alias("q"))
    for r in df.collect():
        assert sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(r["p"], r["q"])) <= len(set(r["x"]) ^ set(r["y"]))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_similar_sets_share_a_part(threshold):
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 9, 10, 11, 19, 20, 21, 60, 200):
        for _ in range(20):
            one = rng.integers(-2**63, 2**63 - 1, size)
            gone = rng.integers(0, size + 1)
            extra = rng.integers(-2**63, 2**63 - 1, rng.integers(0, size + 1))
            two = np.concatenate([one[gone:], extra])
            if len(two) and (size - gone) / (size + len(extra)) >= threshold:
                row, key = neardup._keys(np.concatenate([np.sort(one), np.sort(two)]), np.array([size, len(two)]), threshold)
                assert set(key[row == 0]) & set(key[row == 1])


def test_common_words_bring_no_flood_of_entries(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{w}" for w in rng.sample(range(150), 60))) for i in range(500)]
    written, real = [], neardup.materialize

    def counted(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    assert neardup.removed_by(spark.createDataFrame(rows, "row_id long, text string")).count() == 0
    assert max(written) <= 2 * len(rows)
