"""Blocks of sketches with more candidates than sets list the sets."""

import random

import pytest

from labelmill.llm import near_dedup
from tests.llm.test_near_blocks import labels
from tests.llm.test_operators import link


@pytest.mark.parametrize("wide_sets", [4096, 40])
def test_crowded_blocks_list_no_more_than_their_sets(spark, monkeypatch, wide_sets):
    """All texts share a passage that is too short for similarity, but long enough for the sketches; a few are near copies."""
    monkeypatch.setattr(near_dedup, "FAMILY", 8)
    monkeypatch.setattr(near_dedup, "FAMILIES", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 50)
    monkeypatch.setattr(near_dedup, "WIDE_SETS", wide_sets)
    listed, sets, write = [], [], near_dedup.materialize

    def counted(df, name):
        out = write(df, name)
        if {"a", "b", "g", "h"} <= set(out.columns) and name == "near-wide":
            listed.append(out.count())
        elif name == "near-wide":
            sets.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(200):
        w = list(passage)
        for place in rng.sample(range(100), rng.choice([14, 18, 24])):
            w[place] = f"e{i}x{place}"
        texts[i] = " ".join(w)
    for i in range(10):
        texts[1000 + i] = texts[i * 7] + f" x{i} y{i}"
    got = labels(spark, texts, width=1)
    assert got == link(texts, 1, 80)
    assert 20 < len({c for _, c in got.values()}) < len(texts)
    assert sum(listed) <= sum(sets), (listed, sets)  # a row for each set of a task at most; each pair was a row for each value that it shared
