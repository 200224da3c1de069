"""Near-duplicate documents: SetSketch registers, banded, estimated jointly by likelihood, then verified on the full shingle sets.

A register is the exponentially spaced, truncated minimum of a set's hash values: ``clip(floor(1 - log_b h), 0, q + 1)`` with ``h`` the
least of exponential variates of rate ``a``. Registers of a union are the maxima of the registers, and with ``b`` near 1 two registers
are equal with a probability near the Jaccard similarity. Bands of registers find candidates, the likelihood of the three outcomes
(greater, less, equal) given both set sizes drops those whose most likely similarity is under ``threshold - margin``, and the rest are
compared as full sets.

Scale: sets that are equal collapse to one representative first. A bucket is cut into blocks by a hash of the representative and each
pair of blocks is a unit of work, so no task holds a whole bucket; pairs never become rows. Within a unit only pairs of different
components are compared, and the links that leave it are a forest. At the defaults a pair at a similarity of 0.8 is missed by all 32 bands
with a probability under 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import components, stage, texts
from .words import U, Words, mix, text_slices, window_starts, windows

REGISTERS, BANDS, ROWS = 128, 32, 4
B, A, Q = 1.001, 20.0, 2**16 - 2
BLOCK = 512
_K = np.arange(1, REGISTERS + 1, dtype=U)
_MUL, _ADD = mix(_K * U(0x9E3779B97F4A7C15)) | U(1), mix(_K * U(0xC2B2AE3D27D4EB4F))


def shingle_sets(text: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after another, and where each begins (one more than texts)."""
    w = Words(text)
    h = w.hashes(lower=True)
    counts, first = w.counts, w.first
    keep = window_starts(first, size)
    value = windows(h, size)
    for k in range(1, size):
        # Shorter texts are one shingle: the whole sequence.
        at = first[:-1][counts == k]
        keep[at] = True
        value[at] = mix(windows(h, k)[at] + U(k)) if len(at) else value[at]
    value, owner = value[keep], w.doc_of_word()[keep]
    begin = np.searchsorted(owner, np.arange(len(counts) + 1))
    for lo, hi in zip(begin[:-1], begin[1:]):
        value[lo:hi].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[begin[:-1][begin[:-1] < len(value)]] = True
    begin = np.concatenate([[0], np.cumsum(new)])[begin]
    return value[new], begin


def sketches(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers of each non-empty set, a row each; sets without elements get zeros."""
    out = np.zeros((len(begin) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(begin))
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):
            # About 2**15 values at a time stay in the cache.
            to = max(at + 1, int(np.searchsorted(begin[full], begin[full[at]] + (1 << 15))))
            rows = full[at:to]
            part = value[begin[rows[0]]:begin[rows[-1] + 1]]
            starts = begin[rows] - begin[rows[0]]
            least = np.stack([np.minimum.reduceat(part * m + c, starts) for m, c in zip(_MUL, _ADD)], 1)
            h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / A
            out[rows] = np.clip(np.floor(1 - np.log(h) / math.log(B)), 0, Q + 1)
            at = to
    return out


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(left, right)


def slope(more, less, equal, n_left, n_right, j):
    """Derivative of the joint log-likelihood at similarity ``j``; not negative where the most likely similarity is ``j`` or above."""
    u = n_left / (n_left + n_right)
    v = 1 - u
    c = (B - 1) / B
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p = lambda z: -np.log1p(-z * c) / math.log(B)
    d = lambda z: c / (math.log(B) * (1 - z * c))
    rest = np.maximum(1 - p(x) - p(y), 1e-12)
    return -more * v * d(x) / p(x) - less * u * d(y) / p(y) + equal * (v * d(x) + u * d(y)) / rest


def similarity(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> float:
    """The most likely Jaccard similarity of two sketches of sets of known sizes."""
    more, less = float((left > right).sum()), float((left < right).sum())
    lo, hi = 0.0, min(n_left / n_right, n_right / n_left)
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(more, less, REGISTERS - more - less, n_left, n_right, mid) >= 0 else (lo, mid)
    return (lo + hi) / 2


def likely_pairs(sketch, size, unit, side, band, threshold, margin, skip=None):
    """Yield arrays (i, j) of rows of one unit (rows lie unit by unit) whose most likely similarity is at least ``threshold - margin``
    and whose first common band is the unit's. ``skip(i, j)`` may drop pairs before they are compared."""
    n = len(unit)
    if not n:
        return
    change = np.flatnonzero(np.concatenate([unit[1:] != unit[:-1], [True]])) + 1
    end = change[np.searchsorted(change, np.arange(n), "right")]
    i, step = np.arange(n), 0
    while True:
        step += 1
        i = i[end[i] > i + step]
        if not len(i):
            return
        for at in range(0, len(i), 1 << 14):
            a = i[at:at + (1 << 14)]
            b = a + step
            ok = (side[a] < 0) | (side[a] != side[b])
            ok &= np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            if skip is not None:
                ok &= ~skip(a, b)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            left, right = sketch[a], sketch[b]
            same = (left == right)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2)
            ok = same.argmax(1) == band[a]
            a, b, left, right = a[ok], b[ok], left[ok], right[ok]
            more, less = (left > right).sum(1), (left < right).sum(1)
            ok = slope(more, less, REGISTERS - more - less, size[a], size[b], threshold - margin) >= 0
            if ok.any():
                yield a[ok], b[ok]


class Forest:
    """Union-find over rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def whole_units(batches, key_columns: int, least_rows: int = 4096):
    """Tables of whole units from sorted batches: rows of one unit are never cut apart."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least_rows:
            continue
        t = pa.Table.from_batches(held)
        keys = [t.column(c).to_numpy() for c in range(key_columns)]
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        at = np.flatnonzero(change)
        if len(at):
            yield t.slice(0, at[-1] + 1)
            t = t.slice(at[-1] + 1)
        held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _unit_arrays(t: pa.Table):
    number = lambda c: t.column(c).to_numpy()
    keys = [number(c) for c in ("key", "lo", "hi")]
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    side = np.where(keys[1] == keys[2], -1, number("mine"))
    return sketch, number("n_shingles").astype(np.float64), np.cumsum(change), side, number("band")


def sketch_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, sketch)``: set size, 128 bits that name the set, its registers."""

    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            for lo, hi in text_slices(1 << 20, text):
                value, begin = shingle_sets(text.slice(lo, hi - lo), size)
                sketch = sketches(value, begin)
                with np.errstate(over="ignore"):
                    names = [np.concatenate([[U(0)], np.cumsum(mix(value ^ U(seed)))])[begin] for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                    names = [np.diff(x).view(np.int64) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(begin)), *map(pa.array, names), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.85,
                    margin: float = 0.14) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    A-Z count as a-z; a document's set is its distinct shingles of ``size`` words, or its whole sequence if it has fewer. Documents
    are linked where the Jaccard similarity of their full sets is at least ``threshold``. A null or empty text, or one without words,
    has an empty set and is linked with nothing. A row with a null id is linked with nothing: null component, kept. Repeated rows are
    copies of each other and share a component. Extra columns are not carried.
    """
    percent = round(threshold * 10000)
    docs = texts(docs, id_col, text_col)
    sketched = stage(sketch_documents(docs, size), "sketches")
    named = ["set_a", "set_b", "n_shingles"]
    # Equal sets have equal registers, so any row's will do.
    classes = stage(sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*named).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")

    def bands(batches):
        for b in batches:
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS // ROWS, ROWS)[:, :BANDS].astype(U)
            with np.errstate(over="ignore"):
                key = mix(sketch[:, :, 0] + (sketch[:, :, 1] << U(16)) + (sketch[:, :, 2] << U(32)) + (sketch[:, :, 3] << U(48)))
                key = mix(key + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)
            n = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), b.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))],
                                             names=["key", "band", "rep"])

    banded = classes.select("rep", "sketch").mapInArrow(bands, "key long, band int, rep long")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = banded.join(shared, "key").select("key", "band", "rep", blocks.alias("blocks"), F.expr(f"cast(pmod(xxhash64(rep), ceil(n / {BLOCK})) as int)").alias("mine"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "band", "mine", "rep")
    unit = ["key", "lo", "hi"]
    found = units.join(classes.select("rep", "n_shingles", "set_a", "sketch"), "rep").select(*unit, "band", "mine", "rep", "n_shingles", "set_a", "sketch")
    schema = found.schema

    def candidates(batches):
        for t in whole_units(batches, 3):
            keep = np.zeros(t.num_rows, bool)
            for i, j in likely_pairs(*_unit_arrays(t), threshold, margin):
                keep[i] = keep[j] = True
            yield from t.filter(pa.array(keep)).to_batches()

    likely = stage(found.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(candidates, schema), "likely")
    judged = likely.join(docs.where("doc_id is not null"), F.col("rep") == F.col("doc_id")).drop("doc_id").repartition(*unit).sortWithinPartitions(*unit, "rep")

    def verify(batches):
        for t in whole_units(batches, 3, 256):
            sets, own = [], np.zeros(t.num_rows, bool)
            named_set, text = t.column("set_a").to_numpy(), t.column("text").combine_chunks().cast(pa.large_string())
            for lo, hi in text_slices(1 << 20, text):
                value, begin = shingle_sets(text.slice(lo, hi - lo), size)
                with np.errstate(over="ignore"):
                    total = np.concatenate([[U(0)], np.cumsum(mix(value ^ U(0x5851F42D4C957F2D)))])[begin]
                    own[lo:hi] = np.diff(total).view(np.int64) == named_set[lo:hi]
                sets += [value[x:y] for x, y in zip(begin[:-1], begin[1:])]
            # Another text under the same id isn't the one that was sketched.
            rows = np.flatnonzero(own)
            t, sets = t.take(pa.array(rows)), [sets[r] for r in rows]
            rep, forest, src, dst = t.column("rep").to_numpy(), Forest(t.num_rows), [], []
            roots = [forest.roots()]
            for i, j in likely_pairs(*_unit_arrays(t), threshold, margin, lambda a, b: roots[0][a] == roots[0][b]):
                for x, y in zip(i.tolist(), j.tolist()):
                    if forest.root(x) != forest.root(y):
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 10000 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            forest.join(x, y)
                            src.append(rep[x])
                            dst.append(rep[y])
                roots[0] = forest.roots()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    linked = components(judged.mapInArrow(verify, "src long, dst long"))
    named_rows = sketched.drop("sketch").join(classes.select(*named, "rep"), named, "left")
    out = named_rows.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    # A set that is empty and a null id have no representative.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
