"""Alignment of two tokenizers over the same bytes, and how often each pair of ids is linked in a corpus.

``A`` (byte-level BPE, a ``tokenizers`` file) and ``B`` (a sentencepiece model with byte fallback, which puts a space before a
text) read the same bytes. Byte places where tokens of both end cut a text into groups; two tokens are linked when their bytes
overlap.

1. Neither tokenizer joins anything across a space that follows a visible character, so texts are cut there and each distinct
   word of a block is tokenized, grouped and linked once. :func:`load` refuses a model for which that does not hold.
2. Identity map: the id of ``A`` -> the id of ``B`` with the same bytes. Links between such ids are counted in one vector as
   long as the vocabulary; only the others, from irregular groups, go as pairs through a shuffle, once for each block.
3. The counts come back to the blocks by joins, and each block sums them up for its documents.

A block travels as rows of ``PIECE_BYTES``: a row of megabytes would cost the JVM several large arrays in a row at each step that
copies it. Within a Python worker, words are linked ``CHUNK_WORDS`` at a time and kept as 32-bit numbers.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import materialize

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
STRETCH = 50_000  # characters tokenized by one call
CHUNK_WORDS = 16_384  # distinct words that are tokenized and linked at a time
RUN_WORDS = 50_000  # words whose links are spread out at a time
BLOCK_CHARS = 4_000_000  # texts that share one dictionary; a longer text is a block of its own
PIECE_BYTES = 128 << 10  # of a row that carries a part of a block
PIECES_READ = 32  # rows in a row group, which Spark's reader unpacks at once
CUT = re.compile(r"(?<=[^\s\u180e])(?= )")

_LISTS = ("id", "n_a", "n_b", "n_groups", "n_links")
#: ``piece``: the place of the row in its block; ``same_at``, ``pairs_at``: the place of its first entries among all of the block.
BLOCK = pa.schema([("block", pa.int64()), ("piece", pa.int32()), ("same_at", pa.int32()), ("pairs_at", pa.int32()),
                   *[(c, pa.list_(pa.int64())) for c in _LISTS], ("digest", pa.list_(pa.string())),
                   ("word_count", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("link_count", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())),
                   ("same", pa.list_(pa.int32())), ("same_docs", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("pair_docs", pa.list_(pa.int32()))])
BLOCK_DDL = ("block long, piece int, same_at int, pairs_at int, " + ", ".join(f"{c} array<long>" for c in _LISTS) + ", digest array<string>, word_count array<int>, "
             "words array<int>, link_count array<int>, links array<int>, same array<int>, same_docs array<int>, pairs array<long>, pair_docs array<int>")


class Pair(NamedTuple):
    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    len_a: np.ndarray
    len_b: np.ndarray
    same: np.ndarray   # id of A -> id of B with the same bytes, or -1
    text: np.ndarray   # decimal ids followed by ',', '|' and ';', one after another


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


@functools.lru_cache(maxsize=4)
def load(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    alphabet = _byte_alphabet()
    bytes_a = [b""] * a.get_vocab_size()
    for entry, i in a.get_vocab().items():
        if all(c in alphabet for c in entry):
            bytes_a[i] = bytes(alphabet[c] for c in entry)
    bytes_b, spelled = [], {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if re.search("[^▁]▁", piece):
            raise ValueError(f"piece {i} joins text across a space")
        whole = b"" if b.is_control(i) or b.is_unknown(i) else bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
        bytes_b.append(whole)
        if whole and (whole not in spelled or b.is_byte(spelled[whole])):  # a piece before the byte of the same value
            spelled[whole] = i
    top = max(len(bytes_a), len(bytes_b))
    text = np.array([f"{i}{end}" for end in ",|;" for i in range(top)], object)
    sizes = lambda entries: np.fromiter(map(len, entries), np.int64, len(entries))
    same = np.fromiter((spelled.get(x, -1) if x else -1 for x in bytes_a), np.int64, len(bytes_a))
    return Pair(a, b, bytes_a, bytes_b, sizes(bytes_a), sizes(bytes_b), same, text)


def _offsets(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int64)


def _expand(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the entries of ``rows`` in a list of lists with offsets ``at``."""
    counts = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - _offsets(counts)[:-1], counts) + np.arange(counts.sum())


def _give_back() -> None:
    """Freed memory goes back to the system: a worker lives on, beside others, for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _tokens(text: str, use: Pair) -> tuple[list[int], list[int]] | None:
    """The ids of a stretch that starts with a space; None if they don't spell it."""
    of_a = use.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
    of_b = use.b.encode(text[1:], num_threads=1) if len(text) > 1 else [use.b.piece_to_id("▁")]
    raw = text.encode("utf-8", "surrogatepass")
    spelled = b"".join([use.bytes_a[t] for t in of_a]) == raw and b"".join([use.bytes_b[t] for t in of_b]) == raw
    return (of_a, of_b) if spelled else None


def _stretches(words: list[str]):
    """Runs of words that can be tokenized as one: all but a run's last one end in a visible character."""
    run, chars = [], 0
    for w in words:
        run.append(w)
        chars += len(w)
        if chars >= STRETCH or w[-1].isspace() or w[-1] == "\u180e":
            yield run
            run, chars = [], 0
    if run:
        yield run


def _runs(word_at: np.ndarray):
    """Stretches of whole documents with about ``RUN_WORDS`` words each."""
    start = 0
    while start < len(word_at) - 1:
        end = max(start + 1, int(np.searchsorted(word_at, word_at[start] + RUN_WORDS, side="right")) - 1)
        yield slice(word_at[start], word_at[end])
        start = end


class _Words:
    """The distinct words of a block with their tokens, groups and links."""

    def __init__(self, words: list[str], use: Pair):
        self.bad = np.zeros(len(words), bool)
        of_a, of_b, first = [], [], 0
        for run in _stretches(words):
            both = _tokens("".join(run), use)
            if both is None:  # some word is not spelled by its tokens: look at each
                each = [_tokens(w, use) for w in run]
                self.bad[[first + i for i, found in enumerate(each) if found is None]] = True
                both = tuple([t for found in each if found for t in found[side]] for side in (0, 1))
            of_a.append(np.array(both[0], np.int64))
            of_b.append(np.array(both[1], np.int64))
            first += len(run)
        none = [np.zeros(0, np.int64)]
        ids_a, ids_b = np.concatenate(of_a + none), np.concatenate(of_b + none)
        length = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        word_end = np.cumsum(np.where(self.bad, 0, length))
        end_a, end_b = np.cumsum(use.len_a[ids_a]), np.cumsum(use.len_b[ids_b])
        ends = _distinct(np.concatenate([end_a, end_b]))  # each stretch between two ends is one link
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # and each one up to a common end a group
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        self.n_a, self.n_b = (np.bincount(np.searchsorted(word_end, end), minlength=len(words)).astype(np.int64) for end in (end_a, end_b))
        self.link_a, self.link_b = ids_a[np.searchsorted(end_a, ends)], ids_b[np.searchsorted(end_b, ends)]
        self.n_links = np.bincount(np.searchsorted(word_end, ends), minlength=len(words)).astype(np.int64)
        self.n_groups = np.bincount(np.searchsorted(word_end, both), minlength=len(words)).astype(np.int64)
        # Tokens in the order of the groups' digest, each followed by the sign that ends it.
        in_a, in_b = _offsets(np.bincount(group_a, minlength=len(both))), _offsets(np.bincount(group_b, minlength=len(both)))
        order = np.empty(len(ids_a) + len(ids_b), object)
        top = len(use.text) // 3
        order[np.arange(len(ids_a)) + in_b[group_a]] = use.text[ids_a + top * (both[group_a] == end_a if len(both) else 0)]
        order[np.arange(len(ids_b)) + in_a[group_b + 1]] = use.text[ids_b + 2 * top * (both[group_b] == end_b if len(both) else 0)]
        pieces, at = order.tolist(), _offsets(self.n_a + self.n_b).tolist()
        self.said = ["".join(pieces[i:j]) for i, j in zip(at, at[1:])]


class _Linked(NamedTuple):
    """All distinct words of a block."""

    bad: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    said: list[str]


def _linked(words: list[str], use: Pair) -> _Linked:
    """As :class:`_Words`, a chunk at a time: what linking needs is several times what is kept."""
    chunks: list[tuple] = []
    said: list[str] = []
    for first in range(0, len(words), CHUNK_WORDS) or [0]:
        w = _Words(words[first: first + CHUNK_WORDS], use)
        chunks.append((w.bad, *(x.astype(np.int32) for x in (w.n_a, w.n_b, w.n_groups, w.n_links, w.link_a, w.link_b))))
        said += w.said
    return _Linked(*(np.concatenate(x) for x in zip(*chunks)), said)


def _entries(w: _Linked, use: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(same, pairs, links)``: ids linked with their equal, all other pairs, and the entry of each link, the former first."""
    identity = use.same[w.link_a] == w.link_b
    same, of_same = np.unique(w.link_a[identity], return_inverse=True)
    apart = ~identity
    pairs, of_pair = np.unique((w.link_a[apart].astype(np.int64) << 32) | w.link_b[apart], return_inverse=True)
    links = np.empty(len(identity), np.int32)
    links[identity], links[apart] = of_same, of_pair + len(same)
    return same, pairs, links


def _pieces(number: int, columns: dict[str, pa.Array]):
    """The rows of a block: each has an equal share of every column."""
    rows = max(1, -(-sum(c.nbytes for c in columns.values()) // PIECE_BYTES))
    for piece in range(rows):
        at = {name: len(c) * piece // rows for name, c in columns.items()}
        parts = {name: c.slice(at[name], len(c) * (piece + 1) // rows - at[name]) for name, c in columns.items()}
        lists = {name: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for name, c in parts.items()}
        first = {"block": number, "piece": piece, "same_at": at["same"], "pairs_at": len(columns["same"]) + at["pairs"]}
        yield pa.record_batch([lists[f.name] if f.name in lists else pa.array([first[f.name]], f.type) for f in BLOCK], schema=BLOCK)


def _block(ids: list, rows: list[np.ndarray], words: list[str], use: Pair, number: int):
    w = _linked(words, use)
    rows = [r if not w.bad[r].any() else r[:0] for r in rows]
    word_at, flat = _offsets([len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(word_at))
    total = lambda per_word: np.bincount(doc, per_word[flat], len(rows)).astype(np.int64)
    digest = [hashlib.sha256("".join([w.said[i] for i in r.tolist()])[:-1].encode()).hexdigest() if len(r) else "" for r in rows]
    sums = {"n_a": total(w.n_a), "n_b": total(w.n_b), "n_groups": total(w.n_groups), "n_links": total(w.n_links)}
    same, pairs, links = _entries(w, use)
    n_links, link_at = w.n_links, _offsets(w.n_links)
    del w
    size = np.int64(len(same) + len(pairs) + 1)
    in_docs = np.zeros(size, np.int64)
    for some in _runs(word_at):  # each word of a document once, then each of its entries once
        held = _distinct(doc[some].astype(np.int64) * (len(words) + 1) + flat[some])
        held_doc, held_word = held // (len(words) + 1), held % (len(words) + 1)
        entry = links[_expand(link_at, held_word)]
        in_docs += np.bincount(_distinct(np.repeat(held_doc, n_links[held_word]) * size + entry) % size, minlength=size)
    columns = {"id": ids, **sums, "digest": digest, "word_count": np.diff(word_at).astype(np.int32), "words": flat, "link_count": n_links, "links": links,
               "same": same, "same_docs": in_docs[: len(same)].astype(np.int32), "pairs": pairs, "pair_docs": in_docs[len(same): -1].astype(np.int32)}
    yield from _pieces(number, {name: pa.array(values, BLOCK.field(name).type.value_type) for name, values in columns.items()})


def _blocks(a_file: str, b_file: str, block_chars: int):
    def run(batches):
        use, task, made = load(a_file, b_file), TaskContext.get().partitionId(), 0
        number = lambda: (task << 32) | made
        ids, rows, chars, seen = [], [], 0, defaultdict()
        seen.default_factory = seen.__len__
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids.append(i.as_py())
                rows.append(np.fromiter(map(seen.__getitem__, CUT.split(" " + text)), np.int32) if text else np.zeros(0, np.int32))
                chars += len(text or "")
                if chars >= block_chars:
                    yield from _block(ids, rows, list(seen), use, number())
                    made += 1
                    ids, rows, chars = [], [], 0
                    seen.clear()
                    _give_back()
        if ids:
            yield from _block(ids, rows, list(seen), use, number())
            ids, rows = [], []
            seen.clear()
        _give_back()

    return run


def _sums(block: pa.Table, found: pa.Table) -> pa.Table:
    """One row for each document of a block, with the counts that came back for the block's entries."""
    order = np.argsort(block.column("piece").to_numpy())

    def column(name: str) -> pa.Array:
        lists = block.column(name).combine_chunks()
        return pa.concat_arrays([lists[i].values for i in order.tolist()])

    word_at, words, link_at, links = (column(c).to_numpy(zero_copy_only=False) for c in ("word_count", "words", "link_count", "links"))
    word_at, link_at = _offsets(word_at), _offsets(link_at)
    count, top = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, bool)
    place = found.column("place").to_numpy()
    count[place], top[place] = found.column("docs").to_numpy(), found.column("top").to_numpy(zero_copy_only=False)
    upto = lambda per_link: (lambda c: c[link_at[1:]] - c[link_at[:-1]])(_offsets(per_link[links]))
    per_doc = lambda per_word: (lambda c: c[word_at[1:]] - c[word_at[:-1]])(_offsets(per_word[words]))
    summed = pa.table({**{c: column(c) for c in _LISTS}, "n_best": per_doc(upto(top)), "count_sum": per_doc(upto(count)), "groups_sha256": column("digest")})
    _give_back()
    return summed


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(a, docs)`` of the identity links, ``(pair, docs)`` of the others, ``(a, most)``: the highest count of an id of A."""
    same = blocks.select(F.explode(F.arrays_zip("same", "same_docs")).alias("e")).groupBy(F.col("e.same").alias("a")).agg(F.sum("e.same_docs").alias("docs"))
    same = materialize(same, "align-same")
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.pair_docs").alias("docs"))
    pairs = materialize(pairs, "align-pairs")
    each = same.select("a", "docs").union(pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), "docs"))
    return same, pairs, materialize(each.groupBy("a").agg(F.max("docs").alias("most")), "align-most")


def _read(docs: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str, block_chars: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(texts.mapInArrow(_blocks(a_file, b_file, block_chars), BLOCK_DDL), "align-blocks", PIECES_READ)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row.

    ``n_best``: links whose pair is in as many documents as any pair of its id of A; ``count_sum``: over all links, the documents
    that hold the pair linked. Null and empty texts, and texts whose tokens don't spell their bytes (U+2581, which
    B reads as a space), have no tokens: zeros and an empty digest. Rows that repeat an id, or have none, are documents of their own. Ties count
    as best. Other columns are not carried. No rows: no rows. The files are read by the workers, by path.
    """
    blocks = _read(docs, id_col, text_col, a_file, b_file, block_chars)
    same, pairs, most = _counts(blocks)
    # Both have a row for each id of A at most: bounded by the vocabulary.
    best = F.broadcast(most)
    same = F.broadcast(same.join(best, "a").select("a", "docs", (F.col("docs") == F.col("most")).alias("top")))
    known = (blocks.select("block", "same_at", F.posexplode("same").alias("at", "a")).join(same, "a")
             .select("block", (F.col("same_at") + F.col("at")).alias("place"), "docs", "top"))
    judged = pairs.withColumn("a", F.shiftright("pair", 32).cast("int")).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("top"))
    other = (blocks.select("block", "pairs_at", F.posexplode("pairs").alias("at", "pair")).join(judged, "pair")
             .select("block", (F.col("pairs_at") + F.col("at")).alias("place"), "docs", "top"))
    found = known.union(other).withColumnRenamed("block", "of")
    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_sums, RESULT)


def id_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(a, b, n_docs, best)``: all linked pairs of ids of a corpus, and whether no pair of ``a`` is in more documents.

    Null, empty and unreadable texts hold no pairs; repeated rows count each time. No rows: no rows.
    """
    same, pairs, most = _counts(_read(docs, id_col, text_col, a_file, b_file, block_chars))
    equal = same.mapInArrow(_equals(a_file, b_file), "a long, b long, n_docs long")
    apart = pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.col("docs").alias("n_docs"))
    return equal.union(apart).join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _equals(a_file: str, b_file: str):
    def run(batches):
        for batch in batches:
            a = batch.column(0).to_numpy()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(load(a_file, b_file).same[a], pa.int64()), batch.column(1).cast(pa.int64())], names=["a", "b", "n_docs"])

    return run
