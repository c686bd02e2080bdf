"""Hard negatives: rows of another label that score just below an anchor's positives, found exactly by cover trees.

1. Candidates get one more component, ``sqrt(M - |x|^2)`` with ``M`` the largest squared norm. All then have the same norm, and
   a larger inner product is a smaller distance from an anchor (whose extra component is 0).
2. Rows are dealt to their nearest pivot. The pivots are a sample of at most ``PIVOTS`` rows, the ones with the smallest id
   hashes; they only decide which rows share a block, and a pivot with many rows has several blocks. Each block holds a
   cover tree: a node's children are centres picked farthest-first, so that they lie apart by at least the radius that they cover.
3. A node's covering radius bounds the scores below it on both sides. An anchor goes through a block's leaves best first, skips
   nodes outside all its windows or below its k-th best score, and computes the scores in the other leaves exactly.
4. Each anchor first searches the blocks of its own pivot. The k-th best scores found there are lower bounds, with which the remaining blocks are searched.

Components are whole numbers. Scores are exact while sums stay below 2**53 in absolute value; beyond that they are rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import materialize

PIVOTS = 64
BLOCK_ROWS = 8192    # candidates of a tree
GROUP_ANCHORS = 8192  # anchors, about, that meet a block in one group
CHUNK_ROWS = 256     # of these, how many are searched at a time
LEAF, FAN = 32, 16   # rows of a leaf, children of a node
LOW, HIGH = -(2.0**62), 2.0**62

FOUND = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("id", T.LongType()),
                      T.StructField("score", T.LongType())])


class CoverTree:
    """Rows in leaf order, and nodes by level: centre, covering radius and the stretch of rows below each."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres (place of a row), radii, ends of the stretches
        spans = [(0, len(rows), int(np.argmin(((rows - rows.mean(0)) ** 2).sum(1))))] if len(rows) else []
        while spans:
            radius = [float(np.sqrt(((rows[self.order[a:b]] - rows[c]) ** 2).sum(1).max())) for a, b, c in spans]
            self.levels.append((np.array([c for *_, c in spans]), np.array(radius), np.array([(a, b) for a, b, _ in spans])))
            if all(b - a <= LEAF or r == 0 for (a, b, _), r in zip(spans, radius)):
                break
            spans = [child for span, r in zip(spans, radius) for child in (self._split(rows, *span, r) if span[1] - span[0] > LEAF and r > 0 else [span])]

    def _split(self, rows: np.ndarray, start: int, end: int, centre: int, radius: float) -> list[tuple[int, int, int]]:
        places = self.order[start:end]
        some = rows[places]
        centres, near = [centre], ((some - rows[centre]) ** 2).sum(1)
        nearest = np.zeros(len(places), np.int64)
        while len(centres) < FAN and near.max() > (radius / 2) ** 2:
            centres.append(int(places[near.argmax()]))
            d = ((some - rows[centres[-1]]) ** 2).sum(1)
            closer = d < near
            near[closer], nearest[closer] = d[closer], len(centres) - 1
        by = np.argsort(nearest, kind="stable")
        self.order[start:end] = places[by]
        at = start + np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centres)))])
        return [(int(at[i]), int(at[i + 1]), c) for i, c in enumerate(centres) if at[i + 1] > at[i]]


def _augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(most - (vectors**2).sum(1), 0))[:, None]])


def _width(lists: list, width: int) -> np.ndarray:
    """Vectors of a width, shorter ones filled up with zeros."""
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


class Block:
    """Candidates with their tree; ``search`` finds the best of each anchor's windows among them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        by = np.argsort(ids, kind="stable")
        rows = _augmented(vectors[by], most)
        self.tree = CoverTree(rows)
        by = by[self.tree.order]
        self.ids, self.labels, self.vectors, self.most, self.rows = ids[by], labels[by], vectors[by], most, rows

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest and lowest possible score of each anchor (rows) in each leaf (columns): a node's bounds hold for all below it."""
        norm = (q**2).sum(1)[:, None] + self.most
        high = low = None
        for centres, radius, spans in self.tree.levels:
            d = np.sqrt(np.maximum(norm - 2 * (q @ self.rows[centres, :-1].T), 0))
            top, bottom = (norm - np.maximum(d - radius, 0) ** 2) / 2, (norm - (d + radius) ** 2) / 2
            if high is not None:
                parent = np.searchsorted(ends, spans[:, 0], side="right")
                top, bottom = np.minimum(top, high[:, parent]), np.maximum(bottom, low[:, parent])
            high, low, ends = top, bottom, spans[:, 1]
        slack = 1e-6 * (norm + 1)  # of rounding in the bounds; the scores themselves are exact
        return high + slack, low - slack, self.tree.levels[-1][2]

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, windows: np.ndarray, floors: np.ndarray, k: int):
        """``(anchor, window, place, score)`` of the k best rows of each anchor's windows ``(low, high)``, ties by id.

        ``same``: rows of the anchor's label, else of other labels. ``floors``: scores below which a window needs nothing.
        """
        high, low, spans = self._bounds(q)
        need = np.maximum(windows[:, :, 0], floors)
        scores = np.full((len(q), len(self.ids)), -np.inf)
        fits = (self.labels[None, :] == labels[:, None]) == same
        fits &= self.ids[None, :] != ids[:, None]
        best_first = np.argsort(-high, axis=1, kind="stable")
        step, done = 1, 0
        while done < high.shape[1]:
            rows = np.repeat(np.arange(len(q)), min(step, high.shape[1] - done))
            leaves = best_first[:, done: done + step].ravel()
            # Outside: no window of the anchor has room between the leaf's bounds.
            wanted = ((high[rows, leaves, None] >= need[rows]) & (low[rows, leaves, None] <= windows[rows, :, 1])).any(1)
            rows, leaves = rows[wanted], leaves[wanted]
            by = np.argsort(leaves, kind="stable")
            rows, leaves = rows[by], leaves[by]
            starts = np.flatnonzero(np.concatenate([[True], leaves[1:] != leaves[:-1]])) if len(leaves) else np.zeros(0, np.int64)
            for i, j in zip(starts, [*starts[1:], len(leaves)]):
                a, b = spans[leaves[i]]
                scores[rows[i:j], a:b] = q[rows[i:j]] @ self.vectors[a:b].T
            done += step
            step *= 2
            if done < high.shape[1] and len(self.ids) > k:
                for w in range(windows.shape[1]):
                    inside = np.where(fits & (scores >= need[:, w, None]) & (scores <= windows[:, w, 1, None]), scores, -np.inf)
                    need[:, w] = np.maximum(need[:, w], np.partition(inside, -k, axis=1)[:, -k])
        found = []
        for w in range(windows.shape[1]):
            row, place = np.nonzero(fits & (scores >= need[:, w, None]) & (scores <= windows[:, w, 1, None]))
            got = scores[row, place]
            by = np.lexsort((self.ids[place], -got, row))
            row, place, got = row[by], place[by], got[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            found.append((row[rank < k], np.full((rank < k).sum(), w), place[rank < k], got[rank < k]))
        return [np.concatenate(part) for part in zip(*found)]


def _block_search(most: float, width: int, same: bool, k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and asked.num_rows:
            held = Block(block.column("id").to_numpy(), block.column("label").to_numpy(), _width(block.column("vector").to_pylist(), width), most)
            for start in range(0, asked.num_rows, CHUNK_ROWS):
                part = asked.slice(start, CHUNK_ROWS)
                ids = part.column("anchor_id").to_numpy()
                n = max(map(len, part.column("low").to_pylist()))
                lists = lambda c, fill: np.array([v + [fill] * (n - len(v)) for v in part.column(c).to_pylist()], float)
                windows = np.stack([lists("low", HIGH), lists("high", LOW)], axis=2)
                row, window, place, score = held.search(ids, part.column("anchor_label").to_numpy(), _width(part.column("q").to_pylist(), width), same, windows,
                                                        lists("floor", HIGH), k)
                out.append(pa.table({"anchor_id": ids[row], "window": window.astype(np.int32), "id": held.ids[place], "score": score.astype(np.int64)}))
        none = pa.table({"anchor_id": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.concat_tables([none, *out])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's window, as ``rank`` from 1. At most ``k`` rows come from each block."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Candidates dealt into blocks around pivots."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS):
        shape = rows.agg(F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
        self.width, self.most = shape[0] or 0, shape[1] or 0.0
        picked = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(pivots).collect()  # a bounded sample
        centres = _augmented(_width([r["vector"] for r in picked], self.width), self.most)
        width, most = self.width, self.most

        def nearest(batches):
            for batch in batches:
                found = _augmented(_width(batch.column("vector").to_pylist(), width), most) @ centres.T if len(centres) else np.zeros((batch.num_rows, 1))
                far = (centres**2).sum(1) - 2 * found if len(centres) else found
                yield pa.record_batch([*batch.columns, pa.array(far.argmin(1) if batch.num_rows else [], pa.int32())], names=["id", "label", "vector", "pivot"])

        rows = materialize(rows.select("id", "label", "vector").mapInArrow(nearest, "id long, label long, vector array<double>, pivot int"), "tree-rows")
        sizes = rows.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
        self.sizes = materialize(sizes, "tree-sizes")  # one row for each pivot
        self.rows = rows.join(F.broadcast(self.sizes), "pivot").select(
            F.struct("pivot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")).alias("block"), "id", "label", "vector", "pivot")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """``(anchor_id, window, id, score, rank)``: the ``k`` best rows of each window of ``anchors (anchor_id, anchor_label, pivot, q, low[], high[])``."""
        listed = self.sizes.orderBy("pivot").collect()  # one row for each pivot
        run = _block_search(self.most, self.width, same, k)
        chunks = max(1, -(-anchors.count() // GROUP_ANCHORS))
        chunk = F.pmod(F.xxhash64(F.lit(1), "anchor_id"), F.lit(chunks)).cast("int")

        def visit(asked: DataFrame) -> DataFrame:
            """Each group has a block and a part of the anchors: both are bounded."""
            held = self.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            told = asked.select(F.col("block").alias("to"), chunk.alias("part"), "*").drop("block")
            return held.groupBy("block", "chunk").cogroup(told.groupBy("to", "part")).applyInArrow(run, FOUND)

        def to_blocks(home: bool):
            """Each anchor once for each block of its own pivot, or of all the others: a row holds one vector."""
            each = F.array(*[F.struct(F.lit(r["pivot"]).alias("of"), F.lit(r["blocks"]).alias("blocks")) for r in listed]) if listed else F.array().cast("array<struct<of:int,blocks:int>>")
            mine = F.filter(each, lambda p: (p["of"] == F.col("pivot")) if home else (p["of"] != F.col("pivot")))
            spread = F.flatten(F.transform(mine, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda i: F.struct(p["of"].alias("pivot"), i.alias("part")))))
            return F.explode(spread).alias("block")

        open_floor = F.transform("low", lambda _: F.lit(LOW))
        base = ["anchor_id", "anchor_label", "q", "low", "high"]
        near = materialize(_best(visit(anchors.select(*base, open_floor.alias("floor"), to_blocks(True))), k), "tree-near")
        least = near.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("least"))
        floors = F.transform("low", lambda x, w: F.coalesce(F.element_at("least", w).cast("double"), F.lit(LOW)))
        rest = anchors.join(least, "anchor_id", "left").select(*base, floors.alias("floor"), to_blocks(False))
        far = visit(rest)
        return _best(near.drop("rank").union(far), k)


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows that can take part, one for each id; components as whole numbers ``floor(256 * x)``."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * 256.0).cast("double"))
    bad = F.exists(F.col(vector_col).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    held = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    held = held.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("vector"))
    return held.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def mine_hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors=None,
                        positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, pivots: int = PIVOTS,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For each anchor (rows for which ``anchors``, a condition on ``id``, holds; all by default) its ``positives`` best rows of the same label are
    taken, and for each of these the ``negatives`` best rows of other labels whose score is from ``least_percent`` to
    ``most_percent`` of the positive's. A score is the inner product of ``floor(256 * x)``; ties go to the smaller id. Fewer rows than
    asked for are all returned, none give no row. Rows with a null id, label or vector, or a null or non-finite component take no part. Rows that repeat an id
    are one: the one with the smaller label, then the smaller vector. A shorter vector counts as filled up with zeros. Other
    columns are not carried. No rows: no rows.
    """
    rows = materialize(clean_vectors(rows, id_col, vector_col, label_col), "tree-vectors")
    index = Index(rows, pivots, block_rows)
    asked = index.rows.where(F.lit(True) if anchors is None else anchors).select(F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), "pivot", F.col("vector").alias("q"))
    asked = materialize(asked, "tree-anchors")
    good = index.search(asked.withColumn("low", F.array(F.lit(LOW))).withColumn("high", F.array(F.lit(HIGH))), True, positives)
    good = materialize(good.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "tree-positives")
    windows = good.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    # Scores are whole, so the windows' edges are rounded inwards.
    low = F.transform("p", lambda r: F.ceil(r["positive_score"] * F.lit(least_percent).cast("decimal(20,0)") / 100).cast("double"))
    high = F.transform("p", lambda r: F.floor(r["positive_score"] * F.lit(most_percent).cast("decimal(20,0)") / 100).cast("double"))
    bad = index.search(asked.join(windows.select("anchor_id", low.alias("low"), high.alias("high")), "anchor_id"), False, negatives)
    return (bad.select("anchor_id", (F.col("window") + 1).alias("place"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(good, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
