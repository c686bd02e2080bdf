"""Regions of many texts in one batch, and keys sorted with their places."""

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import substring_dedup
from labelmill.llm.runlength_index import _sorted_keys


def test_regions_of_many_texts_come_in_one_batch(monkeypatch):
    texts = ["0123456789" * 30, None, "äöü" * 60, "x" * 150]
    few, many = [[0, 30, 276], [], None, [5]], [None, None, [7, 100], [126]]
    batch = pa.record_batch([pa.array([4, 5, 6, 7]), pa.array([1, 2, 3, 4]), pa.array(texts), pa.array(few, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int32()))],
                            names=["_id", "_version", "_text", "_few", "_many"])
    (whole,) = substring_dedup._cut_regions(100, 24)([batch])
    expected = []
    for i, (text, *lists) in enumerate(zip(texts, few, many)):
        raw = (text or "").encode()
        for which, places in enumerate(lists):
            for a in places or []:
                expected.append((4 + i, 1 + i, a, bool(which), raw[max(0, a - 76): a + 100]))
    rows = whole.to_pylist()
    assert [(r["_id"], r["_version"], r["_at"], r["_many"], r["_bytes"]) for r in rows] == expected
    places, hashes, _ = substring_dedup.anchor_places(texts[0].encode(), 100, 24)
    again = pa.record_batch([pa.array([1]), pa.array([1]), pa.array(texts[:1]), pa.array([places.tolist()], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32()))], names=batch.schema.names)
    (made,) = substring_dedup._cut_regions(100, 24)([again])
    assert made.column("_h").to_pylist() == hashes.view(np.int64).tolist()
    monkeypatch.setattr(substring_dedup, "REGION_BYTES", 1)
    assert sum((b.to_pylist() for b in substring_dedup._cut_regions(100, 24)([batch])), []) == rows


@pytest.mark.parametrize("bits", [10, 21, 22, 30])
def test_keys_are_sorted_by_both_numbers(bits):
    rng = np.random.default_rng(bits)
    high, low = rng.integers(0, min(2**bits, 50), 500), rng.integers(0, 2**bits, 500) // (2**bits // 8)
    order, key = _sorted_keys(high, low, bits)
    assert order.tolist() == np.lexsort([low, high]).tolist()
    assert key.tolist() == ((high << bits) + low)[order].tolist()
