"""Token alignment holds little at a time: small rows, small row groups, chunks of words."""

import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from labelmill.llm import token_align

USE = token_align.load()
ROW_BYTES = 2 * 128 << 10


def corpus(n_docs=120, n_words=1500):
    rng = random.Random(9)
    syllables = "the wint er house ver ab é漢 ing 20 Stra ße naï un 😀 x".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(30_000)]
    rows = [(i // 2, " ".join(rng.choices(vocabulary, k=n_words))) for i in range(n_docs)]
    return rows + [(None, "the house"), (None, None), (7, ""), (8, "▁ no tokens"), (9, "the house")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(2)


def test_a_block_travels_in_small_rows(docs):
    blocks = token_align._read(docs, "doc_id", "text", token_align.A_FILE, token_align.B_FILE, token_align.BLOCK_CHARS)
    table = blocks.toArrow()
    assert table.num_rows > 2 * len(set(table.column("block").to_pylist()))
    assert max(table.slice(i, 1).combine_chunks().nbytes for i in range(table.num_rows)) <= ROW_BYTES
    groups = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in blocks.inputFiles()]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 32


def test_pieces_give_the_same_rows(docs):
    counted = lambda **how: collections.Counter(tuple(r) for r in token_align.align_tokens(docs, **how).collect())
    large = counted()
    assert large == counted(block_chars=9_000) and large.total() == 125


def test_words_are_linked_in_chunks(monkeypatch):
    words = list(dict.fromkeys(w for _, text in corpus(12) if text for w in token_align.CUT.split(" " + text)))
    whole, held = token_align._Words(words, USE), []
    monkeypatch.setattr(token_align, "_Words", lambda some, use, make=token_align._Words: held.append(len(some)) or make(some, use))
    monkeypatch.setattr(token_align, "CHUNK_WORDS", 1000)
    parts = token_align._linked(words, USE)
    assert max(held) == 1000 and sum(held) == len(words) > 5000 and whole.bad.any()
    for name in parts._fields:
        assert np.array_equal(getattr(parts, name), getattr(whole, name))
        assert name == "said" or getattr(parts, name).dtype.itemsize <= 4
    assert token_align._linked([], USE).said == []
