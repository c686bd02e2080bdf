"""Near duplicates: families compared block against block, other similarities, and small sets, against brute force."""

import random

import pytest

from labelmill.llm import near_dedup
from tests.llm.test_operators import link, words


def labels(spark, texts, **how):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, **how).collect()}


@pytest.mark.parametrize("pair_rows", [64, 0])
def test_families_in_blocks(spark, monkeypatch, pair_rows):
    """Many edits of one text, most pairs of which lie just below the similarity asked for, and two groups that one pair joins."""
    monkeypatch.setattr(near_dedup, "FAMILY", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 40)
    monkeypatch.setattr(near_dedup, "PAIR_ROWS", pair_rows)
    rng = random.Random(11)
    base, texts = words(rng, 150).split(), {}
    base = [f"{w}{i}" for i, w in enumerate(base)]
    for i in range(220):
        w = list(base)
        for place in rng.sample(range(len(w)), rng.choice([4, 7, 8, 9, 10, 11])):
            w[place] = f"e{rng.randrange(10**6)}"
        texts[i * 3] = " ".join(w)
    for i in range(60):
        texts[1000 + i] = " ".join(base[: 60 + i]) + " " + " ".join(f"t{j}" for j in range(40))
    got = labels(spark, texts, width=2)
    assert got == link(texts, 2, 80)
    assert len(set(c for _, c in got.values())) > 20  # not one group


@pytest.mark.parametrize("percent", [70, 75, 90])
def test_similarities(spark, percent):
    rng = random.Random(percent)
    texts = {0: "a b c", 1: "a b c d", 2: "e f", 3: "e f g", 4: "h i j k", 5: "h i j k l", 6: "m n o p q r s t u", 7: "m n o p q r s t u v", 8: "x", 9: "x y"}
    for i in range(10, 60):
        w = [f"w{j}" for j in range(40)]
        for place in rng.sample(range(40), rng.randint(0, 9)):
            w[place] = f"v{i}{place}"
        texts[i] = " ".join(w[: rng.randint(25, 40)])
    assert labels(spark, texts, width=1, percent=percent) == link(texts, 1, percent)
