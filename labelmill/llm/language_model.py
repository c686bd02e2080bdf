"""Scoring texts with a weighted backoff automaton.

States are the training words, the text boundary, and the empty history. A state's arcs are the smoothed pairs that start with it;
any other word takes the state's failure arc to the empty history, whose arcs are the smoothed single words. A text is read
once from left to right. Words seen less often than an arc needs have no arcs, and a failure arc without weight: their pairs
are never counted, which changes no score.

Texts travel as blocks: one row holds the word numbers of some thousand texts and the block's own dictionary. Blocks ask
for what they need (counts and failure arcs of their words) by a join on the word, so that no task or driver ever holds the
whole model, and a frequent word costs one row for each block. Counts of pairs are asked for in bulk: the pairs' hashes are
cut into even ranges, a block sends each range one row with its sorted hashes and counts, packed, and gets one row back that
tells which of them are arcs and how often they were seen. One block, the first that holds it, adds an arc to its state's sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.bytesops import hash_words
from labelmill.llm.common import discard, materialize, whole

BLOCK_TOKENS = 2_000_000
ARC_COUNT = 2        # training occurrences from which a pair is an arc
DISCOUNT = 0.75
END = -7046029254386353131  # stands for the end of a text among the word hashes
RANGE_TOKENS = 2_000_000  # tokens of the corpus for each range of pair hashes

BLOCK = ("block long, ids binary, doc array<long>, held array<boolean>, lengths array<int>, words array<long>, times array<long>")
COUNTED = "block long, ids binary, doc array<long>, held array<boolean>, lengths array<int>, words array<long>, counts binary, n_known array<long>, base array<double>"
ASKED = "part int, block long, hashes binary, times binary"
TOLD = "block long, part int, n int, arcs binary, seen binary"
SUMS = "w long, on_arcs double, singles double"


def _pack(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    width = np.dtype(kind).itemsize
    planes = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes()
    return np.uint64(len(planes)).tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    size, width = int(np.frombuffer(data[:8], np.uint64)[0]), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()
    return numbers.astype(np.int64) if width == 4 else numbers


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The list in the first row of a column."""
    return table.column(column)[0].values.to_numpy()


def _rows(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, arrays = [], []
    for part, value in zip(schema.split(", "), values):
        name, kind = part.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        if kind.startswith("array"):
            flat = value if isinstance(value, pa.Array) else pa.array(value, kinds[inner])
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kinds[inner])))
        else:
            arrays.append(pa.array([value], kinds[kind]))
        names.append(name)
    return pa.record_batch(arrays, names=names)


def _blocks(block_tokens: int):
    """Texts to blocks; a word's number is its rank by frequency in the block."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        docs, held, texts, size = [], [], [], 0

        def done(number: int):
            every = np.concatenate(texts)
            words, at, counts = np.unique(every, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            order = np.argsort(-counts, kind="stable")
            rank[order] = np.arange(len(words))
            ids, lengths = rank[at], np.array([len(t) for t in texts])
            training = np.repeat(~np.array(held, bool), lengths)
            times = np.bincount(ids[training], minlength=len(words))
            return _rows(BLOCK, [(part << 32) + number, _pack(ids), docs, held, lengths, words[order], times])

        for batch in batches:
            for doc, out, text in zip(batch.column("doc").to_pylist(), batch.column("held").to_pylist(), batch.column("text")):
                words = hash_words((text.as_py() or "").encode("utf-8", "surrogatepass").lower()).view(np.int64)
                docs.append(doc)
                held.append(out)
                texts.append(np.append(words, END))
                size += len(words) + 1
                if size >= block_tokens:
                    yield done(made)
                    docs, held, texts, size, made = [], [], [], 0, made + 1
        if docs:
            yield done(made)

    return run


def _single_words(total: int, distinct: int):
    """Per block: the training counts of its words, and each text's base score."""
    below = total + 0.5 * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, lengths = _flat(left, "words"), _flat(left, "lengths").astype(np.int64)
        counts = np.zeros(len(words), np.int64)
        counts[right.column("place").to_numpy()] = right.column("c").to_numpy()
        data = left.column("ids")[0].as_py()
        ids = _unpack(data)
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10((counts + 0.5) / below)[ids], starts)
        known = np.add.reduceat((counts[ids] > 0).astype(np.int64), starts)
        return pa.Table.from_batches([_rows(COUNTED, [
            left.column("block")[0].as_py(), data, left.column("doc")[0].values, left.column("held")[0].values, lengths, words, _pack(counts, "<u8"), known, base])])

    return run


def _pairs(block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's pairs that can be arcs, by the places of their words; the tokens that end one and which, and the word before each token."""
    words, lengths = _flat(block, "words"), _flat(block, "lengths").astype(np.int64)
    ids, counts = _unpack(block.column("ids")[0].as_py()), _unpack(block.column("counts")[0].as_py(), "<u8").astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = int(np.flatnonzero(words == END)[0])  # a text starts where another ends
    state = (counts >= least) | (words == END)
    at = np.flatnonzero(state[before] & state[ids])
    pairs, moves = np.unique(before[at] * len(words) + ids[at], return_inverse=True)
    return pairs // len(words), pairs % len(words), at, moves, before


def _ranged(block, a: np.ndarray, b: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a block's pairs in rising order, the pairs' places, and where each of ``parts`` even ranges starts."""
    words = _flat(block, "words").view(np.uint64)
    mixed = words[a] * np.uint64(0x9E3779B97F4A7C15) + words[b]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    starts = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return mixed[order], order, np.append(np.searchsorted(mixed, starts, sorter=order), len(order))


def _asked(least: float, parts: int):
    """A block's pairs, one row for each range of hashes, with what the block's training texts count of them."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block = batch.slice(i, 1)
                a, b, at, moves, _ = _pairs(block, least)
                training = np.repeat(~block.column("held")[0].values.to_numpy(zero_copy_only=False), _flat(block, "lengths"))[at]
                times = np.bincount(moves[training], minlength=len(a))
                hashes, order, starts = _ranged(block, a, b, parts)
                rows = []
                for part in np.flatnonzero(np.diff(starts)):
                    here = slice(starts[part], starts[part + 1])
                    steps = np.diff(hashes[here], prepend=np.uint64(0))
                    rows.append((part, block.column("block")[0].as_py(), _pack(steps, "<u8"), _pack(times[order[here]])))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                columns = zip(*rows) if rows else ([], [], [], [])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "hashes", "times"])

    return run


def _told(arc_count: int):
    """Per range: to each block, which of its pairs are arcs, how often they were seen, and which of them it is the first to hold."""

    def run(asked: pa.Table) -> pa.Table:
        blocks = asked.column("block").to_numpy()
        rows = np.argsort(blocks, kind="stable")
        hashes = [np.cumsum(_unpack(asked.column("hashes")[int(i)].as_py(), "<u8"), dtype=np.uint64) for i in rows]
        sizes = [len(h) for h in hashes]
        every = np.concatenate(hashes)
        del hashes
        order = np.argsort(every, kind="stable")  # of equal hashes, the first block's stands first
        every = every[order]
        first = np.append(True, every[1:] != every[:-1])
        group = np.cumsum(first) - 1
        times = np.concatenate([_unpack(asked.column("times")[int(i)].as_py()) for i in rows])
        counts = np.add.reduceat(times[order], np.flatnonzero(first))
        seen = np.empty(len(order), np.int64)
        seen[order] = counts[group]
        owned = np.empty(len(order), bool)
        owned[order] = first
        arcs, told, at = seen >= arc_count, [], 0
        for size in sizes:
            here = slice(at, at + size)
            hits = arcs[here]
            told.append((size, np.packbits(hits).tobytes(), _pack(seen[here][hits], "<u8") + np.packbits(owned[here][hits]).tobytes()))
            at += size
        n, bits, counted = zip(*told)
        part = asked.column("part")[0].as_py()
        return pa.table([pa.array(blocks[rows]), pa.array([part] * len(rows), pa.int32()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(counted, pa.binary())],
                        names=["block", "part", "n", "arcs", "seen"])

    return run


def _arcs(block, told: pa.Table, a: np.ndarray, b: np.ndarray, total: int, distinct: int, parts: int, discount: float):
    """Of a block's pairs: the places of those that are arcs, their weights, their second words' own weights, and which the block is first to hold."""
    _, order, starts = _ranged(block, a, b, parts)
    seen, owned = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for part, n, bits, counted in zip(*[told.column(c).to_pylist() for c in ("part", "n", "arcs", "seen")]):
        places = order[starts[part] : starts[part + 1]][np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)]
        flags = (len(places) + 7) // 8
        seen[places] = _unpack(counted[: len(counted) - flags], "<u8").astype(np.int64)
        owned[places] = np.unpackbits(np.frombuffer(counted[len(counted) - flags :], np.uint8), count=len(places)).view(bool)
    counts = _unpack(block.column("counts")[0].as_py(), "<u8").astype(np.int64)
    at = np.flatnonzero(seen)
    return at, (seen[at] - discount) / counts[a[at]], (counts[b[at]] + 0.5) / (total + 0.5 * (distinct + 1)), owned[at]


def _state_sums(least: float, *model):
    """Per block: for each first word, the summed weights of the arcs that this block is the first to hold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _flat(left, "words")
        a, b, *_ = _pairs(left, least)
        at, arc, single, owned = _arcs(left, right, a, b, *model)
        firsts = a[at[owned]]
        used = np.unique(firsts)
        sums = [np.bincount(firsts, weights=x[owned], minlength=len(words))[used] for x in (arc, single)]
        return pa.table({"w": pa.array(words[used]), "on_arcs": pa.array(sums[0], pa.float64()), "singles": pa.array(sums[1], pa.float64())})

    return run


def _traverse(least: float, *model):
    """Per block: what arcs and failure arcs add to the base score, summed along each text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = _flat(left, "lengths").astype(np.int64)
        a, b, at, moves, before = _pairs(left, least)
        fails = right.filter(pa.compute.is_valid(right.column("place")))
        failure = np.zeros(len(_flat(left, "words")))
        failure[fails.column("place").to_numpy()] = fails.column("adds").to_numpy()
        on_arc = failure[a]
        arcs, arc, single, _ = _arcs(left, right.filter(pa.compute.is_valid(right.column("part"))), a, b, *model)
        on_arc[arcs] = np.log10(arc) - np.log10(single)
        gained = failure[before]
        gained[at] = on_arc[moves]
        base = _flat(left, "base")
        return pa.table({"doc": left.column("doc")[0].values, "held_out": left.column("held")[0].values, "n_tokens": pa.array(lengths), "n_known": left.column("n_known")[0].values,
                         "base_score": pa.array(base), "score": pa.array(base + np.add.reduceat(gained, np.cumsum(lengths) - lengths))})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_share: float = 0.0, arc_count: int = ARC_COUNT,
                discount: float = DISCOUNT, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Tokens: words (runs without ASCII white space, A-Z lower-cased) and one end. Rows with ``crc32(id) % 5 = 1`` are held out; the others
    train. ``base_score`` uses single words, ``(c + 0.5) / (N + 0.5 (V + 1))``; ``score`` is the automaton's log10 probability: an arc
    has ``(c(h, w) - discount) / c(h)``, a failure arc the mass that is left over that of the words not on arcs. Null text:
    the end only. A null id trains. Repeated rows count as often as they stand. No rows: no rows. If nothing trains, all counts are 0.
    Words and pairs are told apart by 64-bit hashes. One task takes one range of pair hashes: ``range_tokens`` hashes on average, and
    one for each block of a pair that is in all of them. ``state_share``: the share of all training tokens from which a word is a state; 0: every word is.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), held.alias("held"), whole(text_col).alias("text"))
    blocks = materialize(texts.mapInArrow(_blocks(block_tokens), BLOCK), "lm-blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("place", "x")).select("block", "place", F.col("x.words").alias("w"), F.col("x.times").cast("int").alias("n"))
    of_word = Window.partitionBy("w")
    counted = materialize(words.select("block", "place", "w", F.sum("n").over(of_word).alias("c"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("once")), "lm-words")
    total, distinct = counted.where("once AND c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(1.0, arc_count, state_share * total)
    # One task takes one block and its counts; a block's size is bounded by ``block_tokens`` and one text.
    known = (blocks.groupBy("block").cogroup(counted.select("block", "place", "c").groupBy("block"))
             .applyInArrow(_single_words(total, distinct), COUNTED))
    known = materialize(known, "lm-counted")
    discard(blocks)  # the counted blocks hold all that is still needed of them
    tokens = known.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-tokens // range_tokens))
    model = (total, distinct, parts, discount)
    asked = known.select("block", "ids", "held", "lengths", "words", "counts").mapInArrow(_asked(least, parts), ASKED)
    told = materialize(asked.groupBy("part").applyInArrow(_told(arc_count), TOLD), "lm-arcs")
    sums = known.select("block", "ids", "lengths", "words", "counts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_state_sums(least, *model), SUMS)
    fail = (sums.groupBy("w").agg(F.sum("on_arcs").alias("on_arcs"), F.sum("singles").alias("singles"))
            .select("w", F.log10((1 - F.col("on_arcs")) / (1 - F.col("singles"))).alias("adds")))
    fail = materialize(fail, "lm-fail")  # so that the blocks' first shuffle goes before their second
    # A block gets one row for each of its words with a failure arc, and one for each range of its pairs.
    of_words = counted.select("block", "place", "w").join(fail, "w").select("block", "place", "adds")
    answers = of_words.unionByName(told, allowMissingColumns=True)
    scored = known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _traverse(least, *model), "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
