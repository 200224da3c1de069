"""Exact top-k inner products from a bit-sliced index.

Rows of a block are indexed by bitmaps: for each component and each bit of its offset value one bitmap over the rows. The scores of a
query are the sum of such slices: a component with weight w adds its slices at every set bit of w, carry-save adders with bitwise
operations sum all slices of a weight at once, and the result is again a set of slices, one for each bit of the score. The best rows
are then selected from the most significant slice downward: rows with the bit set are taken while fewer than k are, else the others
are dropped. Rows left at the boundary are equal in every slice, so they have the same exact score and the smaller ids fill the rest.

Components are shifted to be non-negative, those of negative weight are complemented; both change all scores of a query by the same
amount, which is taken off again.

Scale: each task slices its rows in blocks of at most ``block_rows`` and these are staged once, without a shuffle and whatever ids are
equal. Queries travel to the blocks in packets of at most ``block_queries``; a block is sent to several places only so that there is work
for all cores, and to one more for each 8,192 queries. A task holds one block and one packet at a time. Every pair returns at most k rows a
query; a window over these picks the best. Neither side is broadcast or gathered.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import narrow, stage, widen


class Index:
    """Bit slices of a block: ``slices[d][b]`` is the bitmap of bit b of component d over rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: list[int], bitmaps: np.ndarray):
        self.ids, self.low, self.bits, self.rows = ids, low, bits, len(ids)
        self.words = -(-self.rows // 64)
        self.ones = self._bitmap(np.ones(self.rows, bool))
        cut = np.cumsum([0, *bits])
        self.slices = [list(bitmaps[i:j]) for i, j in zip(cut[:-1], cut[1:])]

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> tuple["Index", np.ndarray]:
        """The index of rows, and the order of their ids in which it holds them."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(0)
        shifted = (values - low).astype(np.uint64)
        bits = [int(m).bit_length() for m in shifted.max(0)]
        out = cls(ids, low, bits, np.zeros((sum(bits), -(-len(ids) // 64)), np.uint64))
        out.slices = [[out._bitmap((shifted[:, d] >> np.uint64(b)) & np.uint64(1) > 0) for b in range(n)] for d, n in enumerate(bits)]
        return out, order

    def bitmaps(self) -> bytes:
        return b"".join(b.tobytes() for some in self.slices for b in some)

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and what is to be added to each score."""
        at: list[list[np.ndarray]] = []
        constant = 0
        for d, w in enumerate(query.tolist()):
            constant += w * int(self.low[d])
            if not w or not self.bits[d]:
                continue
            if w < 0:
                constant += w * ((1 << self.bits[d]) - 1)
            weight = abs(w)
            for b, bitmap in enumerate(self.slices[d]):
                if w < 0:
                    bitmap = bitmap ^ self.ones
                for s in range(weight.bit_length()):
                    if weight >> s & 1:
                        while len(at) <= b + s:
                            at.append([])
                        at[b + s].append(bitmap)
        out, level = [], 0
        while level < len(at):
            todo = at[level]
            while len(todo) > 1:
                # Full adders: three slices of a weight become one of it and one of twice it, as many trios at once as there are.
                n = len(todo) // 3
                if n:
                    x, y, z = (np.stack(todo[k * n:(k + 1) * n]) for k in range(3))
                    half = x ^ y
                    total, carry = half ^ z, (x & y) | (half & z)
                    rest = todo[3 * n:]
                else:
                    total, carry, rest = (todo[0] ^ todo[1])[None], (todo[0] & todo[1])[None], []
                todo = [*rest, *total]
                if level + 1 == len(at):
                    at.append([])
                at[level + 1].extend(carry)
            out.append(todo[0] if todo else np.zeros(self.words, np.uint64))
            level += 1
        return out, constant

    def flags(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.rows, bitorder="little"))

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows other than row ``own``, ties to smaller ids, in no order."""
        slices, constant = self.score_slices(query)
        taken, left = np.zeros(self.words, np.uint64), self.ones.copy()
        if own is not None:
            left[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        n_taken = 0
        for bitmap in reversed(slices):
            with_bit = left & bitmap
            n = int(np.bitwise_count(with_bit).sum())
            if n_taken + n > k:
                left = with_bit
            else:
                taken, n_taken = taken | with_bit, n_taken + n
                left = left & ~bitmap
                if n_taken == k:
                    break
        rows = self.flags(taken)
        if n_taken < k:
            rows = np.concatenate([rows, self.flags(left)[:k - n_taken]])
        score = np.full(len(rows), constant, np.int64)
        for b, bitmap in enumerate(slices):
            score += ((bitmap[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        return rows, score


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(id, v array<long>)``: floor(scale * x) of each component; rows with a null id, vector or component, or a non-finite one, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(ok)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrices(t: pa.Table):
    """(length, ids, matrix) for each vector length in the table."""
    lists = t.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat, ids = lists.flatten().to_numpy(), t.column("id").to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), ids[rows], flat[begin[rows][:, None] + np.arange(n)].reshape(len(rows), n)


_INDEX = "block long, width int, ids array<long>, low array<long>, bits array<long>, bitmaps binary, asked array<long>, queries binary"
_FOUND = "home long, row long, query_id long, block long, place long, vec_id long, score long"


def _lists(*names: str) -> list:
    return [(n, pa.list_(pa.int64())) for n in names]


def index(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows(id, v, asked)`` as sliced blocks, staged: one row for each block and vector length."""
    schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), *_lists("ids", "low", "bits"), ("bitmaps", pa.binary()), *_lists("asked"), ("queries", pa.binary())])

    def build(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held, size = [], 0

        def blocks():
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = np.asarray(pc.list_value_length(t.column("v")))
            for width, ids, values in _matrices(t):
                made, order = Index.build(ids, values)
                asked = np.flatnonzero(np.asarray(t.column("asked"))[sizes == width][order])
                yield pa.RecordBatch.from_pylist([{"block": next(number), "width": width, "ids": made.ids, "low": made.low, "bits": made.bits, "bitmaps": made.bitmaps(), "asked": asked, "queries": narrow(values[order][asked])}], schema)

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, block_rows - size)
                held.append(b.slice(0, take))
                b, size = b.slice(take), size + take
                if size == block_rows:
                    yield from blocks()
                    held, size = [], 0
        if size:
            yield from blocks()

    return stage(rows.select("id", "v", "asked").mapInArrow(build, _INDEX), "slices")


def packets(blocks: DataFrame, size: int) -> DataFrame:
    """The rows asked for, at most ``size`` in one: their block, places, ids and vectors."""
    schema = pa.schema([("home", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), *_lists("asked", "ids"), ("queries", pa.binary())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                asked, ids = np.array(r["asked"], np.int64), np.array(r["ids"], np.int64)
                values = widen(r["queries"], len(asked), r["width"])
                for k in range(0, len(asked), size):
                    some = asked[k:k + size]
                    yield pa.RecordBatch.from_pylist([{"home": r["block"], "part": k // size, "width": r["width"], "asked": some, "ids": ids[some], "queries": narrow(values[k:k + size])}], schema)

    return blocks.where(F.size("asked") > 0).select("block", "width", "ids", "asked", "queries").mapInArrow(run, "home long, part int, width int, asked array<long>, ids array<long>, queries binary")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0,
          block_rows: int = 65536, block_queries: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each row for which ``is_query`` (a condition on ``id``) holds, by the
    integer inner product of floor(scale * component), ties to the smaller id; all candidates if there are fewer.

    Every row but the query itself is a candidate. Rows with null, NaN or infinite components take no part, nor do null ids; vectors of
    different lengths are never compared; an empty vector scores 0 with other empty ones. Repeated rows, and rows that share an id, count
    each by itself: as queries, each with its own ranks, and as candidates. An empty table gives an empty result. Products must fit in 63
    bits. Extra columns are ignored.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    cores, total = vectors.sparkSession.sparkContext.defaultParallelism, vectors.count()
    # A query costs a walk over the slices of a block whatever its size, so small parts of a table are read together.
    parts = max(math.ceil(total / block_rows), min(cores // 2, math.ceil(4 * total / block_rows)), 1)
    blocks = index(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))).coalesce(parts), block_rows)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("asked")).alias("asked")).first()
    asked = size["asked"] or 0
    slices = max(math.ceil(asked / 8192), min(math.ceil(2 * cores / max(size["blocks"], 1)), math.ceil(asked / block_queries)), 1)
    none = lambda kind: F.lit(None).cast(kind)
    left = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "width", "ids", F.col("bitmaps").alias("data"), "low", "bits",
                         none("long").alias("home"), none("array<long>").alias("asked"))
    sent = packets(blocks, block_queries).join(blocks.select("block", "width"), "width")
    right = sent.select("block", F.expr(f"cast(pmod(xxhash64(home, part), {slices}) as int)").alias("slice"), F.lit(1).alias("kind"), "width", "ids", F.col("queries").alias("data"),
                        none("array<long>").alias("low"), none("array<long>").alias("bits"), "home", "asked")
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])

    def run(batches):
        here, place = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = np.array(r["ids"], np.int64)
                if not r["kind"]:
                    bitmaps = np.frombuffer(r["data"], np.uint64).reshape(sum(r["bits"]), -(-len(ids) // 64))
                    here, place = Index(ids, np.array(r["low"], np.int64), r["bits"], bitmaps), (r["block"], r["slice"])
                    continue
                assert place == (r["block"], r["slice"]), "a packet without its block"
                out = []
                for row, query_id, query in zip(r["asked"], ids, widen(r["data"], len(ids), r["width"])):
                    best, score = here.top(query, k, row if r["home"] == r["block"] else None)
                    n = len(best)
                    out.append((np.full(n, r["home"]), np.full(n, row), np.full(n, query_id), np.full(n, r["block"]), best, here.ids[best], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=schema)

    found = left.unionByName(right).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind").mapInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("home", "row").orderBy(F.desc("score"), "vec_id", "block", "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
