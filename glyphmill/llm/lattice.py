"""Near-duplicate vectors by lattice hashing.

In each of ``tables`` tables a unit vector is projected to two random 8-dimensional subspaces and each projection is decoded to the
nearest point of the E8 lattice; the two points name its home cell. A vector also looks into the ``probes`` neighbouring cells that its
projections are nearest to, stepping along a minimal vector of the lattice. Vectors that meet in the home cell of one of them are compared
by cosine in double precision. At the defaults a pair at a cosine of exactly 0.9 in 64 dimensions is missed with a probability near 0.002.

Scale: equal vectors collapse to one class with a multiplicity. Cells are cut into blocks by a hash of the class and each pair of blocks is
a unit of work. A pair that meets in several cells counts only in the first of them, which both vectors name by themselves, so links
are counted inside the tasks and never become rows; a forest of them leaves each unit for the components.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .minhash import Forest, whole_units
from .shared import components, stage
from .words import BASE, U, mix

BLOCK = 1024
_MADE: dict = {}


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the sum is odd, the coordinate furthest from its integer goes the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(np.mod(near.sum(1), 2))
    off = (x - near)[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by a half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    if "roots" in _MADE:
        return _MADE["roots"]
    pairs = [[s if k == i else r if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s, r in itertools.product((1, -1), repeat=2)]
    halves = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    _MADE["roots"] = np.array([*pairs, *halves], float)
    return _MADE["roots"]


def projections(dims: int, tables: int, seed: int) -> np.ndarray:
    """Two matrices of 8 columns for each table, orthonormal if there are 8 dimensions or more."""
    key = dims, tables, seed
    if key not in _MADE:
        draw = np.random.default_rng([seed, dims]).normal(size=(tables, 2, dims, 8))
        _MADE[key] = np.linalg.qr(draw)[0] if dims >= 8 else draw / np.sqrt(8)
    return _MADE[key]


def cells(unit: np.ndarray, tables: int, probes: int, threshold: float, seed: int) -> np.ndarray:
    """Cell names of unit vectors, ``[vector, table, 0]`` the home cell and the others the neighbours looked into."""
    n, dims = unit.shape
    scale = 1.9 * np.sqrt(2 - 2 * threshold) * np.sqrt(8 / max(dims, 8))
    out = np.empty((n, tables, 1 + probes), np.int64)
    roots = minimal_vectors()
    weights = mix(np.arange(1, 17, dtype=U) * BASE)
    for t, pair in enumerate(projections(dims, tables, seed)):
        y = [unit @ w / scale for w in pair]
        home = [nearest_e8(v) for v in y]
        gain = np.concatenate([(v - h) @ roots.T for v, h in zip(y, home)], 1)
        best = np.argpartition(-gain, probes, 1)[:, :probes] if probes else np.zeros((n, 0), int)
        point = np.rint(2 * np.concatenate(home, 1)).astype(np.int64)
        for p in range(1 + probes):
            at = point
            if p:
                at = point.copy()
                step = np.rint(2 * roots[best[:, p - 1] % 240]).astype(np.int64)
                second = best[:, p - 1] >= 240
                at[~second, :8] += step[~second]
                at[second, 8:] += step[second]
            with np.errstate(over="ignore"):
                out[:, t, p] = mix((at.view(U) * weights).sum(1) + U(t + 1) * U(0xD6E8FEB86659FD93) + U(dims)).view(np.int64)
    return out


def _units(raw: list[bytes], kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that the squares of very large or small components stay finite.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = 12,
                   probes: int = 3, seed: int = 7) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors of one length are linked where their cosine is at least ``threshold``. A vector that is null, empty, zero or has null or
    non-finite components, or whose id is null, links with nothing: no links, itself its component, kept. Repeated rows are vectors of
    their own. Extra columns are not carried.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    raw = F.col(vector_col) if kind == "<f4" else F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("x", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("x")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    # -0.0 and 0.0 are the same component.
    rows = rows.withColumn("x", F.transform("x", lambda c: c + F.lit(0).cast(element if kind == "<f4" else "double")))
    rows = rows.withColumn("a", F.when(F.col("fine"), F.xxhash64("x"))).withColumn("b", F.when(F.col("fine"), F.xxhash64(F.lit(1), "x")))
    classes = stage(rows.where("fine").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.min("x").alias("x")), "vectors")

    def to_cells(batches):
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, begin = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), 4096):
                    part = at[lo:lo + 4096]
                    v = np.ascontiguousarray(flat[begin[part][:, None] + np.arange(d)].astype(kind))
                    c = cells(_units([v.tobytes()] if len(part) == 1 else [r.tobytes() for r in v], kind), tables, probes, threshold, seed)
                    n, each = len(part), tables * (1 + probes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.ravel()), pa.array(np.tile(np.arange(each, dtype=np.int32) // (1 + probes), n)), pa.array(np.tile(np.arange(each) % (1 + probes) == 0, n)),
                         b.column(0).take(pa.array(np.repeat(part, each)))], names=["key", "t", "home", "rep"])

    placed = classes.select("rep", "x").mapInArrow(to_cells, "key long, t int, home boolean, rep long")
    # A cell that is nobody's home links nothing.
    met = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("home").alias("lived")).where("n > 1 and lived").select("key", "n")
    members = placed.join(met, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "t", "home", "mine", "rep")
    unit = ["key", "lo", "hi"]

    def to_bytes(batches):
        for b in batches:
            lists = b.column(2)
            flat, off = lists.flatten().to_numpy().astype(kind), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[x:y].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())], names=["rep", "many", "v"])

    packed = classes.select("rep", "many", "x").mapInArrow(to_bytes, "rep long, many long, v binary")
    work = units.join(packed, "rep").select(*unit, "t", "home", "mine", "rep", "many", "v").repartition(*unit).sortWithinPartitions(*unit, "rep")

    def compare(batches):
        for t in whole_units(batches, 3):
            key, lo, hi, table, mine, rep, many = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "t", "mine", "rep", "many"))
            home = t.column("home").to_numpy()
            raw = t.column("v").to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
            links, forest, src, dst = np.zeros(len(key), np.int64), Forest(len(key)), [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if b - a < 2 or not home[a:b].any():
                    continue
                x = _units(raw[a:b], kind)
                left = np.flatnonzero(home[a:b])
                close = x[left] @ x.T >= threshold
                if lo[a] != hi[a]:
                    close &= mine[a:b][left][:, None] != mine[a:b][None]
                i, j = np.nonzero(close)
                i = left[i]
                # Two that live here are seen from both sides.
                ok = (i < j) | ((i > j) & ~home[a:b][j])
                i, j = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
                if not len(i):
                    continue
                named = np.unique(np.concatenate([i, j]))
                place = np.zeros(b - a, np.int64)
                place[named] = np.arange(len(named))
                c = cells(x[named], tables, probes, threshold, seed)
                for s in range(0, len(i), 1 << 14):
                    p, q = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
                    cp, cq = c[place[p]], c[place[q]]
                    in_p, in_q = (cq == cp[:, :, :1]).any(2), (cp == cq[:, :, :1]).any(2)
                    first = (in_p | in_q).argmax(1)
                    rows_ = np.arange(len(p))
                    cell = np.where(in_p[rows_, first], cp[rows_, first, 0], cq[rows_, first, 0])
                    ok = (first == table[a]) & (cell == key[a])
                    p, q = p[ok] + a, q[ok] + a
                    links += np.bincount(p, many[q], len(key)).astype(np.int64) if len(p) else 0
                    links += np.bincount(q, many[p], len(key)).astype(np.int64) if len(p) else 0
                    if len(p):
                        root = forest.roots()
                        apart = root[p] != root[q]
                        for u, w in zip(p[apart].tolist(), q[apart].tolist()):
                            if forest.join(u, w):
                                src.append(rep[u])
                                dst.append(rep[w])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[some], np.array(src, np.int64)])), pa.array([None] * len(some) + dst, pa.int64()),
                                              pa.array(np.concatenate([links[some], np.zeros(len(src), np.int64)]))], names=["src", "dst", "n"])

    found = stage(work.mapInArrow(compare, "src long, dst long, n long"), "links")
    counted = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("n")).withColumnRenamed("src", "rep")
    joined = components(found.where("dst is not null").select("src", "dst")).withColumnRenamed("id", "rep")
    of_class = classes.select("a", "b", "rep", "many").join(counted, "rep", "left").join(joined, "rep", "left").select(
        "a", "b", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "a", "b").join(of_class, ["a", "b"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
