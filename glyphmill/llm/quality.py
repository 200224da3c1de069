"""Quality of documents from random-indexing word vectors and a small network.

* words: runs of letters, of digits and of other signs; each has a sparse random index vector, ``_NONZERO`` entries of +1 or -1 among
  ``dim``, fixed by its hash
* context vectors: the index vectors of the two words on either side, summed over all words of all texts. Words are counted into
  ``buckets`` by their hash, so that the table has a fixed size and no word is left out
* word vectors: context vectors per context, less the mean of the corpus, at unit length, in whole numbers; so the sums below don't
  depend on the order of rows
* a document is the mean of its words' vectors, and of the products of neighbouring ones (large where words repeat); a network with one hidden layer tells label 1 from label 0
* temperature: the factor of the network's margin with the best likelihood on a fifth of the labelled texts, which it was not fitted to

Scale: contexts are summed in tasks and by a partial aggregation over ``buckets`` rows, whatever the corpus; the table that reaches
the driver and travels with the code holds ``buckets`` * ``dim`` numbers. At most ``sample`` labelled texts train the network (those
with the smallest hash of their id). Scoring is a map over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import stage
from .words import BASE, U, Words, mix, text_slices

_NONZERO, _REACH, _STEP = 4, 2, 1024
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (one more than texts)."""
    w = Words(text)
    kind = _KIND[w.data]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[w.offsets] = True
    cut = np.flatnonzero(edge)
    inside = kind[cut[:-1]] > 0 if len(kind) else np.zeros(0, bool)
    w.starts, w.ends = cut[:-1][inside[:len(cut) - 1]], cut[1:][inside[:len(cut) - 1]]
    return w.hashes(), np.searchsorted(w.starts, w.offsets)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % U(buckets)).astype(np.int64)


def contexts(hashes: np.ndarray, first: np.ndarray, buckets: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the index vectors around the words of each bucket, and how many there are."""
    total, seen = np.zeros(buckets * dim), np.zeros(buckets)
    doc, at = np.repeat(np.arange(len(first) - 1), np.diff(first)), _bucket(hashes, buckets)
    bits = mix(hashes ^ BASE)
    entry = [((bits >> U(16 * j)) % U(dim)).astype(np.int64) for j in range(_NONZERO)]
    sign = [1.0 - 2.0 * ((bits >> U(16 * j + 15)) & U(1)).astype(float) for j in range(_NONZERO)]
    for step in range(1, _REACH + 1):
        near = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.zeros(0, np.int64)
        for here, there in ((near, near + step), (near + step, near)):
            row = at[here] * dim
            seen += np.bincount(at[here], minlength=buckets)
            total += np.bincount(np.concatenate([row + e[there] for e in entry]), np.concatenate([s[there] for s in sign]), buckets * dim)
    return total.reshape(buckets, dim), seen


def word_vectors(docs: DataFrame, buckets: int, dim: int) -> np.ndarray:
    """The vector of each bucket, from all texts; that of a bucket without contexts is 0."""
    names = [f"c{k}" for k in range(dim)]

    def run(batches):
        total, seen = np.zeros((buckets, dim)), np.zeros(buckets)
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            for lo, hi in text_slices(2 << 20, text):
                t, s = contexts(*tokens(text.slice(lo, hi - lo)), buckets, dim)
                total, seen = total + t, seen + s
        rows = np.flatnonzero(seen)
        for lo in range(0, len(rows), 4096):
            some = rows[lo:lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64)), *[pa.array(total[some, k].astype(np.int64)) for k in range(dim)]], names=["b", "n", *names])

    summed = docs.select("text").mapInArrow(run, "b int, n long, " + ", ".join(f"{c} long" for c in names)).groupBy("b").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    t = summed.toArrow()
    vectors, n = np.zeros((buckets, dim)), np.zeros(buckets)
    at = t.column("b").to_numpy()
    n[at] = t.column("n").to_numpy()
    for k, c in enumerate(names):
        vectors[at, k] = t.column(c).to_numpy()
    mean = vectors.sum(0) / max(n.sum(), 1)
    vectors = np.where(n[:, None] > 0, vectors / np.maximum(n, 1)[:, None] - mean, 0)
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return np.rint(_STEP * vectors / np.where(length > 0, length, 1)).astype(np.int16)


def pooled(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean vector of its words, and mean products of neighbours' components; 0 without words."""
    text, out = text.cast(pa.large_string()), [np.zeros((0, 2 * vectors.shape[1]))]
    for lo, hi in text_slices(1 << 20, text):
        hashes, first = tokens(text.slice(lo, hi - lo))
        at, width = _bucket(hashes, len(vectors)), vectors.shape[1]
        sums = np.zeros((hi - lo, 2 * width), np.int64)
        for k in range(0, len(at), 1 << 15):
            # One word more than is summed, for the last product.
            some = vectors[at[k:k + (1 << 15) + 1]].astype(np.int32)
            n = min(len(some), 1 << 15)
            rows = np.searchsorted(first, np.arange(k, k + len(some)), "right") - 1
            pairs = np.zeros((n, width), np.int32)
            inside = np.flatnonzero(rows[1:] == rows[:-1])
            pairs[inside] = some[inside] * some[inside + 1]
            starts = np.flatnonzero(np.diff(rows[:n], prepend=-1))
            sums[rows[starts]] += np.hstack([np.add.reduceat(x, starts, dtype=np.int64) for x in (some[:n], pairs)])
        count = np.diff(first)[:, None]
        out.append(np.hstack([sums[:, :width] / np.maximum(count, 1) / _STEP, sums[:, width:] / np.maximum(count - 1, 1) / _STEP**2]))
    return np.concatenate(out)


class Network:
    """Two layers: tanh units over standardised inputs, one logistic output at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, ridge: float = 1e-3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.temperature = 1.0
        self.constant = None if len(y) and 0 < y.mean() < 1 else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        # A fifth of the rows sets the temperature.
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        z, target = (x[~held] - self.mean) / self.scale, y[~held].astype(float)
        self.layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in self.layers]
        t, size = 0, 256
        for _ in range(rounds):
            order = rng.permutation(len(target))
            for k in range(0, len(order), size):
                some = order[k:k + size]
                t += 1
                for p, (m, v), g in zip(self.layers, state, self._gradient(z[some], target[some], ridge)):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if held.any():
            margin, truth = self.margin(x[held]), y[held]
            options = np.exp(np.linspace(np.log(0.2), np.log(10), 200))
            loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * margin / c).mean() for c in options]
            self.temperature = float(options[int(np.argmin(loss))])

    def _gradient(self, z, target, ridge):
        w1, b1, w2, b2 = self.layers
        h = np.tanh(z @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - target) / len(target)
        back = np.outer(g, w2) * (1 - h * h)
        return z.T @ back + ridge * w1, back.sum(0), h.T @ g + ridge * w2, np.array([g.sum()])

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -30, 30)))


def _train(docs: DataFrame, labels: DataFrame, label_col: str, vectors: np.ndarray, sample: int) -> Network:
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "labelled")
    # At most ``sample`` short rows: their bound is the parameter. Copies of a text count once.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("text", "y").agg(F.min("doc_id").alias("doc_id"))

    def run(batches):
        for b in batches:
            x = pooled(b.column(0), vectors)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "doc_id", "x"])

    t = stage(rows.select("text", "y", "doc_id").mapInArrow(run, "y int, doc_id long, x array<double>"), "quality-sample").toArrow()
    ids, y = t.column("doc_id").to_numpy(), t.column("y").to_numpy()
    # In an order of their own, whatever order they come in.
    order = np.lexsort((y, ids, mix(ids.astype(np.int64).view(np.uint64))))
    x = np.array(t.column("x").to_pylist(), float).reshape(len(ids), 2 * vectors.shape[1])
    return Network(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             cutoff: float = 0.7, sample: int = 20000, buckets: int = 1 << 14, dim: int = 64) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row: the probability of label 1 and whether it reaches ``cutoff``.

    Rows for which ``held_out`` (a condition on ``doc_id``) holds are scored, but none of their labels is learnt from; their texts count
    for the word vectors like all others. A null text counts as empty; an empty text has the vector 0 and its score. A null id is not
    held out, unless the condition says so, and trains nothing. Repeated rows are scored alike; of repeated ids among ``labels`` the
    largest label holds. Without labelled rows every score is 0.5, with one label only it is that label. Extra columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    vectors = word_vectors(plain, buckets, dim)
    network = _train(plain, labels.select("doc_id", label_col).where(~held), label_col, vectors, sample)

    def run(batches):
        for b in batches:
            score = network.score(pooled(b.column(1), vectors))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return plain.withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
