"""Bytes inside long strings that also start earlier in the corpus, by run-length indexes of candidate regions.

1. Winnowing picks anchors: of all ``ANCHOR``-byte strings in each window of ``span`` bytes the one with the smallest hash. Equal
   windows have equal anchors, so only anchors found twice can lie in a repeated window; around each of these the region
   is kept that holds all windows with this anchor.
2. Equal regions fold (map-side minimum): all but the first occurrence are repeated as a whole.
3. Anchors with several different regions: the first occurrences go, many anchors together, into a run-length index of about ``CHUNK``
   bytes; matching statistics are streamed through it and mark windows that also stand at an earlier place.
4. An anchor with more than ``BOUND`` regions (a common phrase in ever new surroundings) is not indexed in one task: its
   windows are counted by hash with map-side minima. That is exact too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.bytesops import mix64, power_tables
from labelmill.llm.common import Carried, materialize, small, whole
from labelmill.llm.runlength_index import RunLengthIndex

ANCHOR = 24
CHUNK = 1 << 18
BOUND = 8192
REGION_BYTES = 1 << 23  # of regions that are sent on at once
PIECE = 1 << 18
BROADCAST_ROWS = 1_000_000
_PLACE_BITS = np.uint64((1 << 20) - 1)
_SEED = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
ROW = "_id bigint, _version bigint"


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, modulo 2**64, and the powers that make stretches comparable."""
    powers, inverses = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEED[data] * powers[: len(data)], out=sums[1:])
    return sums, inverses


def stretch_hashes(sums: np.ndarray, inverses: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def anchor_places(raw: bytes, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: places, hashes, and hashes of their regions.

    Of the ``k``-byte strings in each window of ``span`` bytes the leftmost with the smallest hash; the place stands in the
    low bits of the compared numbers. Long texts are worked off in pieces that overlap by the reach of a region.
    """
    found = []
    at, n, w = 0, len(raw), span - k + 1
    while n - at >= span:
        low, high = max(0, at - span), min(n, at + PIECE + 2 * span)
        data = np.frombuffer(raw[low:high], np.uint8)
        sums, inverses = prefix_sums(data)
        begin, stop = at - low, min(at + PIECE + span - 1, n) - k + 1 - low  # k-byte strings of windows that start in this piece
        h = mix64((sums[begin + k : stop + k] - sums[begin:stop]) * inverses[begin:stop] + np.uint64(k))  # stretch_hashes of all places
        key = (h & ~_PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        padded = np.concatenate([key, np.full((-len(key)) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
        forward = np.minimum.accumulate(padded, axis=1).ravel()
        backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(key) - w + 1
        least = np.minimum(backward[:m], forward[w - 1 : w - 1 + m])
        spots = (least & _PLACE_BITS).astype(np.int64)  # they never go back from one window to the next
        spots = spots[np.append(True, spots[1:] != spots[:-1])]
        place = spots + begin
        left, right = np.maximum(place - (span - k), 0), np.minimum(place + span, len(data))
        found.append((place + low, h[spots], stretch_hashes(sums, inverses, left, right)))
        at += PIECE
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(found) == 1:
        return found[0]
    places, index = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return places, np.concatenate([f[1] for f in found])[index], np.concatenate([f[2] for f in found])[index]


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _count_anchors(span: int, k: int):
    def run(batches):
        for batch in batches:
            hashes = [anchor_places(_raw(t), span, k)[1] for t in batch.column(0)]
            once, times = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([pa.array(once.view(np.int64)), pa.array(times.astype(np.int64))], names=["_h", "_times"])

    return run


def _list_anchors(span: int, k: int):
    def run(batches):
        for batch in batches:
            each = [anchor_places(_raw(t), span, k) for t in batch.column("_text")]
            counts = [len(e[0]) for e in each]
            repeat = pa.array(np.repeat(np.arange(len(counts)), counts))
            cat = lambda i, kind: pa.array(np.concatenate([e[i] for e in each] or [np.zeros(0, kind)]).view(np.int64))
            yield pa.record_batch([batch.column("_id").take(repeat), batch.column("_version").take(repeat), cat(1, np.uint64), cat(0, np.int64), cat(2, np.uint64)],
                                  names=["_id", "_version", "_h", "_at", "_region"])

    return run


def _cut_regions(span: int, k: int):
    """The regions around given places, with the anchors' hashes made again from the text; those of many texts in one batch of about ``REGION_BYTES``."""
    powers = power_tables(k)[0][:k]
    names = ["_id", "_version", "_h", "_at", "_many", "_bytes"]

    def made(rows, many, heads, cut):
        ids, versions, at = (np.concatenate([np.full(len(r[2]), r[i], np.int64) if i < 2 else r[2] for r in rows]) for i in range(3))
        data = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, k)
        h = mix64((_SEED[data] * powers).sum(axis=1, dtype=np.uint64) + np.uint64(k))
        arrays = [pa.array(ids), pa.array(versions), pa.array(h.view(np.int64)), pa.array(at), pa.array(np.array(many, bool)), pa.array(cut, pa.binary())]
        return pa.record_batch(arrays, names=names)

    def run(batches):
        for batch in batches:
            rows, many, heads, cut = [], [], [], []
            for i, v, text, *lists in zip(*(batch.column(c) for c in ("_id", "_version", "_text", "_few", "_many"))):
                raw = None
                for which, places in enumerate(lists):
                    if not places.is_valid or not len(places.values):
                        continue
                    raw = _raw(text) if raw is None else raw
                    at = places.values.to_numpy().astype(np.int64)
                    rows.append((i.as_py(), v.as_py(), at))
                    for a in at.tolist():
                        heads.append(raw[a : a + k])
                        cut.append(raw[max(0, a - (span - k)) : a + span])
                    many.extend([bool(which)] * len(at))
                    if len(cut) * 2 * span >= REGION_BYTES:
                        yield made(rows, many, heads, cut)
                        rows, many, heads, cut = [], [], [], []
            if cut:
                yield made(rows, many, heads, cut)

    return run


def mark_chunk(ids: np.ndarray, versions: np.ndarray, starts: np.ndarray, regions: list[bytes], span: int) -> pa.RecordBatch:
    """Windows of the regions of one chunk that stand earlier in it: ``(_id, _version, _from, _to)``, neighbours joined."""
    index = RunLengthIndex(regions, span)
    rank = np.unique(np.stack([ids, versions], axis=1), axis=0, return_inverse=True)[1].ravel()
    offset = np.arange(index.size) - (index.ends - index.lengths)[index.owner]
    places = (rank[index.owner] << 40) | (starts[index.owner] + offset)
    string, start = index.long_matches(places)
    order = np.lexsort([start, string])
    string, start = string[order], start[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    who = string[first] if len(string) else np.zeros(0, np.int64)
    if not len(string):
        first = last = who
    return pa.record_batch([pa.array(ids[who]), pa.array(versions[who]), pa.array(starts[who] + start[first]), pa.array(starts[who] + start[last] + span)],
                           names=["_id", "_version", "_from", "_to"])


def _index_chunks(span: int, k: int):
    """Over rows sorted by anchor: whole groups are gathered up to the size of a chunk and indexed together."""

    def run(batches):
        rows, size, last = [], 0, None

        def done():
            ids, versions, at = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
            return mark_chunk(ids, versions, np.maximum(at - (span - k), 0), [r[3] for r in rows], span)

        for batch in batches:
            for i, v, h, at, data in zip(*(batch.column(c).to_pylist() for c in ("_id", "_version", "_h", "_at", "_bytes"))):
                if h != last and size >= CHUNK:
                    yield done()
                    rows, size = [], 0
                rows.append((i, v, at, data))
                size, last = size + len(data), h
        if rows:
            yield done()

    return run


def _windows(span: int, k: int):
    """All windows of large groups, by two hashes."""

    def run(batches):
        for batch in batches:
            ids, versions, ones, twos, starts = [], [], [], [], []
            for i, v, at, data in zip(*(batch.column(c).to_pylist() for c in ("_id", "_version", "_at", "_bytes"))):
                sums, inverses = prefix_sums(np.frombuffer(data, np.uint8))
                begin = np.arange(max(0, len(data) - span + 1))
                half = span // 2
                ones.append(stretch_hashes(sums, inverses, begin, begin + half))
                twos.append(stretch_hashes(sums, inverses, begin + half, begin + span))
                starts.append(begin + max(0, at - (span - k)))
                ids.append(np.full(len(begin), i))
                versions.append(np.full(len(begin), v))
            cat = lambda x, kind=np.int64: pa.array(np.concatenate(x or [np.zeros(0, kind)]).astype(kind).view(np.int64))
            yield pa.record_batch([cat(ids), cat(versions), cat(ones, np.uint64), cat(twos, np.uint64), cat(starts)], names=["_id", "_version", "_w1", "_w2", "_from"])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1] if len(starts) else reach


def _merge(batches):
    """The spans of each document as maximal runs."""
    for batch in batches:
        spans = batch.column("_all")
        offsets, values = spans.offsets.to_numpy(), spans.values
        starts, ends = values.field("_from").to_numpy(), values.field("_to").to_numpy()
        runs = [merged(starts[a:b], ends[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        cut = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([r[i] for r in runs] or [np.zeros(0, np.int64)]))) for i in (0, 1)]
        yield pa.record_batch([batch.column("_id"), batch.column("_version"), *lists], names=["_id", "_version", "_starts", "_ends"])


def _remove(names: list[str], counts: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            kept, numbers = [], []
            for text, starts, ends in zip(batch.column("_text"), batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist()):
                raw = _raw(text)
                gone = [(max(0, a), min(len(raw), b)) for a, b in zip(starts or [], ends or [])]
                edges = [0, *[x for run_ in gone for x in run_], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                numbers.append((len(raw), sum(b - a for a, b in gone), len(gone)))
            made = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(3)]
            yield pa.record_batch([*[batch.column(c) for c in names], *made, pa.array(kept, pa.binary())], names=[*names, *counts, "kept_bytes"])

    return run


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100, k: int = ANCHOR) -> DataFrame:
    """``docs`` without ``text_col`` but with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (what remains, joined).

    A byte of a text's UTF-8 form goes when a string of ``span`` bytes that covers it also starts earlier: in a document with a
    smaller id, or earlier in the same one. Judged on the input as it stands. Null text: empty. A null id counts as the
    smallest. Rows that repeat an id and its text are one document (each gets its result); other texts with the same id
    come in the order of a hash of the text. Texts shorter than ``span`` stay. No rows: no rows. Columns
    with the names of the results are replaced.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(whole(text_col)).alias("_version"), whole(text_col).alias("_text")]
    texts = docs.select(*key)
    counted = texts.select("_text").mapInArrow(_count_anchors(span, k), "_h bigint, _times bigint")
    twice = materialize(counted.groupBy("_h").agg(F.sum("_times").alias("n")).where("n > 1").select("_h"), "anchors")
    listed = texts.mapInArrow(_list_anchors(span, k), f"{ROW}, _h bigint, _at bigint, _region bigint")
    places = materialize(listed.join(twice, "_h", "left_semi"), "anchor-places")
    first = places.groupBy("_h", "_region").agg(F.min(F.struct("_id", "_version", "_at")).alias("f"), F.count("*").alias("n"))
    first = materialize(first.select("_h", "_region", "n", F.col("f._id").alias("i"), F.col("f._version").alias("v"), F.col("f._at").alias("p")), "regions")
    again = (places.join(first.where("n > 1").select("_h", "_region", "i", "v", "p"), ["_h", "_region"])
             .where("_id <> i OR _version <> v OR _at <> p").select("_id", "_version", (F.col("_at") - (span - k)).alias("_from"), (F.col("_at") + span).alias("_to")))
    several = first.groupBy("_h").agg(F.count("*").alias("regions")).where("regions > 1").select("_h", (F.col("regions") > BOUND).alias("_many"))
    spots = (first.join(several, "_h").groupBy(F.col("i").alias("_id"), F.col("v").alias("_version"))
             .agg(F.collect_set(F.when(~F.col("_many"), F.col("p").cast("int"))).alias("_few"), F.collect_set(F.when(F.col("_many"), F.col("p").cast("int"))).alias("_many")))
    spots = materialize(spots, "region-spots")
    cut = _with_texts(texts, spots)
    regions = materialize(cut.mapInArrow(_cut_regions(span, k), f"{ROW}, _h bigint, _at bigint, _many boolean, _bytes binary"), "region-bytes")
    indexed = (regions.where("NOT _many").repartition("_h").sortWithinPartitions("_h", "_id", "_version", "_at")
               .mapInArrow(_index_chunks(span, k), f"{ROW}, _from bigint, _to bigint"))
    windows = regions.where("_many").mapInArrow(_windows(span, k), f"{ROW}, _w1 bigint, _w2 bigint, _from bigint")
    windows = materialize(windows, "region-windows")
    earliest = windows.groupBy("_w1", "_w2").agg(F.min(F.struct("_id", "_version", "_from")).alias("e"), F.count("*").alias("n")).where("n > 1")
    counted_out = (windows.join(earliest, ["_w1", "_w2"]).where(F.struct("_id", "_version", "_from") > F.col("e"))
                   .select("_id", "_version", "_from", (F.col("_from") + span).alias("_to")))
    marks = again.unionByName(indexed).unionByName(counted_out).groupBy("_id", "_version").agg(F.collect_list(F.struct("_from", "_to")).alias("_all"))
    marks = materialize(marks.mapInArrow(_merge, f"{ROW}, _starts array<bigint>, _ends array<bigint>"), "byte-marks")
    counts = ("n_bytes", "n_removed", "n_spans")
    rest = Carried(docs, *counts, "kept_bytes", text_col)
    held = [f"_in{i}" for i in range(len(rest.names))]
    joined = _with_texts(docs.select(*rest.cols, *key), marks, "left")
    schema = ", ".join([*([rest.fields] if held else []), *[f"{c} bigint" for c in counts], "kept_bytes binary"])
    return joined.select(*held, "_text", "_starts", "_ends").mapInArrow(_remove(held, counts), schema).select(*rest.back(), *counts, "kept_bytes")


def _with_texts(texts: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with a table of one row for each document; that is sent to all tasks while it is small, else both are shuffled."""
    return texts.join(F.broadcast(side) if small(side, BROADCAST_ROWS) else side, ["_id", "_version"], how)
