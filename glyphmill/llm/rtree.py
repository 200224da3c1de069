"""Hard negatives from STR-packed R-trees of whole-number vectors.

Rows of a block are packed by sort-tile-recursion: cut into slabs along the component of largest variance, each slab along the next
one, and so on down to leaves. A node holds the least and largest value of each component and of the labels below it. With a query these
intervals bound every inner product below the node from both sides. A best-first queue, ordered by the upper bound, opens nodes; one
is pruned where its bounds lie outside every score window asked for, or strictly below the k-th best score of each (a node that only
reaches it may hold a tie with a smaller id). A query asks for all its windows in one walk.

Scale: each task packs its rows in blocks of at most ``block_rows`` and these are staged once, without a shuffle and whatever rows are
equal. Queries travel to the blocks in packets of at most ``packet`` rows; a block is sent to ``slices`` places only so that there is
work for all cores, and one more for each 8,192 queries. A task holds one block and one packet at a time. Each pair returns at most k
rows a query and window, of which a window function takes the best. Nothing is broadcast or gathered in one place. The comparison is of
the stated queries with all rows, in blocks; the bounds save work inside a block, they can't avoid sending it.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bit_sliced import _matrices
from .shared import narrow, stage, widen

_FAR = np.int64(1 << 62)


def str_order(values: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their leaves, and where each leaf begins."""
    dims = np.argsort(-values.var(0), kind="stable") if values.size else np.zeros(0, int)
    begins, order, at = [], [], 0
    todo = [(np.arange(len(values)), 0)]
    while todo:
        rows, level = todo.pop()
        leaves = math.ceil(len(rows) / leaf)
        if leaves <= 1 or level >= len(dims):
            begins.extend(range(at, at + len(rows), leaf))
            order.append(rows)
            at += len(rows)
            continue
        rows = rows[np.argsort(values[rows, dims[level]], kind="stable")]
        # Slabs of whole leaves, about the third root of them.
        slabs = max(2, round(leaves ** (1 / 3)))
        step = math.ceil(leaves / slabs) * leaf
        todo.extend((rows[k:k + step], level + 1) for k in range((len(rows) - 1) // step * step, -1, -step))
    return np.concatenate([np.zeros(0, np.int64), *order]).astype(np.int64), np.array(begins, np.int64)


class Tree:
    """Boxes over the rows of a block, which are in leaf order; ``levels[0]`` are the leaves."""

    def __init__(self, ids, labels, values, begins, fanout: int = 16):
        self.ids, self.labels, self.begins = ids, labels, np.append(begins, len(ids))
        self.most = int(np.abs(values).max()) if values.size else 0
        self.values = values
        self.floats = values.astype(float)
        at = begins
        boxes = [f.reduceat(values, at) for f in (np.minimum, np.maximum)] + [f.reduceat(labels, at) for f in (np.minimum, np.maximum)]
        self.levels = [boxes]
        while len(boxes[2]) > fanout:
            at = np.arange(0, len(boxes[2]), fanout)
            boxes = [f.reduceat(b, at) for f, b in zip((np.minimum, np.maximum) * 2, boxes)]
            self.levels.append(boxes)
        self.fanout = fanout
        self.float_levels = [(b[0].astype(float), b[1].astype(float)) for b in self.levels]

    def bounds(self, level: int, nodes: slice, q, exact: bool):
        low, high = self.float_levels[level] if exact else self.levels[level][:2]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = low[nodes], high[nodes]
        return low @ up + high @ down, high @ up + low @ down

    def search(self, query: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int, own: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and scores of the k best rows in each window ``low <= score <= high``, of the query's label or of others; ``own`` is left out."""
        # Sums below 2**53 are exact in floating point.
        exact = self.most * (int(np.abs(query).max()) if len(query) else 0) * max(len(query), 1) < 1 << 52
        q = query.astype(float) if exact else query
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        floor = np.array(low)
        queue: list = []

        def push(level, nodes):
            least, most = self.bounds(level, nodes, q, exact)
            first, last = self.levels[level][2][nodes], self.levels[level][3][nodes]
            ok = (first <= label) & (last >= label) if same else (first != label) | (last != label)
            for j in np.flatnonzero(ok & (most >= floor.min()) & (least <= high.max())):
                heapq.heappush(queue, (-int(most[j]), level, nodes.start + int(j), int(least[j])))

        push(len(self.levels) - 1, slice(0, len(self.levels[-1][2])))
        while queue:
            leaves = []
            while queue and len(leaves) < 8:
                most, level, node, least = heapq.heappop(queue)
                if not ((-most >= floor) & (least <= high)).any():
                    continue
                if level:
                    push(level - 1, slice(node * self.fanout, min((node + 1) * self.fanout, len(self.levels[level - 1][2]))))
                else:
                    leaves.append(np.arange(self.begins[node], self.begins[node + 1]))
            if not leaves:
                break
            rows = np.concatenate(leaves)
            score = ((self.floats if exact else self.values)[rows] @ q).astype(np.int64)
            ok = ((self.labels[rows] == label) == same) & (rows != own) & (score >= floor.min()) & (score <= high.max())
            rows, score = rows[ok], score[ok]
            for w in range(len(low)):
                fits = (score >= floor[w]) & (score <= high[w])
                if not fits.any():
                    continue
                row, s = np.concatenate([found[w][0], rows[fits]]), np.concatenate([found[w][1], score[fits]])
                best = np.lexsort((self.ids[row], -s))[:k]
                found[w] = row[best], s[best]
                if len(best) == k:
                    floor[w] = s[best[-1]]
        return found


_INDEX = "block long, width int, ids array<long>, labels array<long>, asked array<long>, begins array<long>, values binary"
_PACKET = "home long, part int, width int, rows array<long>, ids array<long>, labels array<long>, values binary"


def index(rows: DataFrame, block_rows: int = 16384, leaf: int = 64) -> DataFrame:
    """``rows(id, label, v, asked)`` as packed blocks, staged: one row for each block and vector length."""

    def pack(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        batch, size = [], 0

        def blocks():
            t = pa.Table.from_batches(batch).combine_chunks()
            for width, ids, values in _matrices(t):
                sizes = pc.list_value_length(t.column("v"))
                at = np.flatnonzero(np.asarray(sizes) == width)
                order, begins = str_order(values, leaf)
                labels, asked = t.column("label").to_numpy()[at][order], np.asarray(t.column("asked"))[at][order]
                yield pa.RecordBatch.from_pylist([{"block": next(number), "width": width, "ids": ids[order], "labels": labels, "asked": np.flatnonzero(asked), "begins": begins, "values": narrow(values[order])}], schema)

        schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("ids", "labels", "asked", "begins")], ("values", pa.binary())])
        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, block_rows - size)
                batch.append(b.slice(0, take))
                b, size = b.slice(take), size + take
                if size == block_rows:
                    yield from blocks()
                    batch, size = [], 0
        if size:
            yield from blocks()

    return stage(rows.select("id", "label", "v", "asked").mapInArrow(pack, _INDEX), "rtree")


def packets(blocks: DataFrame, packet: int) -> DataFrame:
    """The rows asked for, at most ``packet`` in one."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                asked = np.array(r["asked"], np.int64)
                ids, labels, values = np.array(r["ids"], np.int64), np.array(r["labels"], np.int64), widen(r["values"], len(r["ids"]), r["width"])
                for k in range(0, len(asked), packet):
                    rows = asked[k:k + packet]
                    yield pa.RecordBatch.from_pylist([{"home": r["block"], "part": k // packet, "width": r["width"], "rows": rows, "ids": ids[rows], "labels": labels[rows], "values": narrow(values[rows])}], schema)

    schema = pa.schema([("home", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("rows", "ids", "labels")], ("values", pa.binary())])
    return blocks.where(F.size("asked") > 0).mapInArrow(run, _PACKET)


def _meet(blocks: DataFrame, asked: DataFrame, slices: int, same: bool, k: int) -> DataFrame:
    """The k best of every block for each query and window of ``asked``, which are packets with arrays first, low, high (the windows of row i are first[i] to first[i + 1])."""
    none = lambda kind: F.lit(None).cast(kind)
    left = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "width", "ids", "labels", F.col("begins").alias("rows"), "values",
                         none("long").alias("home"), none("array<long>").alias("first"), none("array<long>").alias("low"), none("array<long>").alias("high"))
    right = asked.join(blocks.select("block", "width"), "width").select("block", F.expr(f"cast(pmod(xxhash64(home, part), {slices}) as int)").alias("slice"), F.lit(1).alias("kind"), "width", "ids", "labels", "rows", "values",
                                                                        "home", "first", "low", "high")
    schema = pa.schema([("home", pa.int64()), ("row", pa.int64()), ("query_id", pa.int64()), ("window", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        tree, place = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, labels = np.array(r["ids"], np.int64), np.array(r["labels"], np.int64)
                values = widen(r["values"], len(ids), r["width"])
                if not r["kind"]:
                    tree, place = Tree(ids, labels, values, np.array(r["rows"], np.int64)), (r["block"], r["slice"])
                    continue
                assert place == (r["block"], r["slice"]), "a packet without its block"
                first, low, high = (np.array(r[c], np.int64) for c in ("first", "low", "high"))
                out = []
                for q in range(len(ids)):
                    span = slice(first[q], first[q + 1])
                    if span.start == span.stop:
                        continue
                    own = r["rows"][q] if r["home"] == r["block"] else -1
                    for w, (row, score) in enumerate(tree.search(values[q], labels[q], same, low[span], high[span], k, own)):
                        n = len(row)
                        out.append((np.full(n, r["home"]), np.full(n, r["rows"][q]), np.full(n, ids[q]), np.full(n, w), np.full(n, r["block"]), row, tree.ids[row], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    met = left.unionByName(right).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")
    return met.mapInArrow(run, "home long, row long, query_id long, window int, block long, place long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("home", "row", "window").orderBy(F.desc("score"), "id", "block", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10,
                   percent: tuple[int, int] = (30, 90), scale: float = 256.0, block_rows: int = 16384, packet: int = 64) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: rows of another label that are nearly as close to an anchor as one of its positives.

    The score of a row is its inner product with the anchor, of floor(scale * component). The positives of an anchor (a row for which the
    condition ``is_anchor`` holds) are its best ``positives`` other rows of its label, the negatives of each its best ``negatives`` rows
    of other labels with percent[0] * positive score <= 100 * score <= percent[1] * positive score; all, if fewer. Ties go to the smaller
    id. A negative positive score leaves no window, one of 0 that of the score 0.

    Rows with a null id, label, vector or component, or a non-finite component, take no part. Vectors of different lengths are never
    compared. Repeated rows, and rows that share an id, count each by itself: as anchors, positives and negatives. An empty table gives an
    empty result. Products must fit in 62 bits. Extra columns are ignored.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = rows.where("id is not null and label is not null and x is not null").where(ok).withColumn("v", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))))
    blocks = index(rows, block_rows)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("asked")).alias("asked")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    slices = max(math.ceil((size["asked"] or 0) / 8192), min(math.ceil(2 * cores / max(size["blocks"], 1)), math.ceil((size["asked"] or 0) / packet)), 1)
    anchors = stage(packets(blocks, packet), "rtree-anchors")
    every = F.array_repeat(F.lit(int(_FAR)), F.size("ids"))
    open_ = anchors.withColumns({"first": F.sequence(F.lit(0).cast("long"), F.size("ids").cast("long")), "low": F.transform(every, lambda v: -v), "high": every})
    chosen = stage(_best(_meet(blocks, open_, slices, True, positives), positives).select("home", "row", F.col("rank").alias("nth"), F.col("query_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "rtree-positives")

    # A packet's rows and the positives of these: at most ``packet`` times ``positives``.
    place = anchors.select(F.col("home").alias("at"), F.col("part").alias("packet"), F.explode("rows").alias("place"))
    asked = chosen.join(place, (F.col("home") == F.col("at")) & (F.col("row") == F.col("place"))).select("at", "packet", "row", "nth", "positive_score")
    low, high = percent

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        got: dict = {}
        for p in sorted(right.to_pylist(), key=lambda p: p["nth"]):
            got.setdefault(p["row"], []).append(p["positive_score"])
        scores = [s for row in r["rows"] for s in got.get(row, [])]
        first = np.cumsum([0, *[len(got.get(row, [])) for row in r["rows"]]])
        r |= {"first": first, "low": [-(-low * s // 100) for s in scores], "high": [high * s // 100 for s in scores]}
        return pa.Table.from_pylist([r], schema)

    schema = pa.schema([("home", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("rows", "ids", "labels")], ("values", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("first", "low", "high")]])
    ready = anchors.groupBy("home", "part").cogroup(asked.groupBy("at", "packet")).applyInArrow(windows, _PACKET + ", first array<long>, low array<long>, high array<long>")
    best = _best(_meet(blocks, stage(ready, "rtree-windows"), slices, False, negatives), negatives)
    # Window w of a query belongs to its positive of rank w + 1.
    joined = best.join(chosen.select("home", "row", (F.col("nth") - 1).alias("window"), "positive_id", "positive_score"), ["home", "row", "window"])
    return joined.select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
