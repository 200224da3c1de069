"""Toxicity by a classifier chain over word features.

The chain goes through the label columns in order. Each link is a logistic model over the presence of selected words and the
probabilities of the links before it. A later link is trained on out-of-fold probabilities: those of models that have not seen the row.

Scale: at most ``sample`` labelled documents (those with the smallest hash of their id) train the chain; this is the bound of everything
that reaches the driver, together with the ``wanted`` most telling words of each label (those whose log-likelihood gain is at least ``least_gain``). Word counts of the sample are summed in tasks, then by Spark. Scoring
is a map over all documents with a model of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import stage
from .words import Words, mix, text_slices

_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without punctuation at their ends, A-Z as a-z, and the text of each; every word once a text."""
    w = Words(text)
    for _ in range(4):
        w.ends = w.ends - ((w.ends > w.starts) & _EDGE[w.data[np.maximum(w.ends - 1, 0)]] if len(w.data) else 0)
        w.starts = w.starts + ((w.ends > w.starts) & _EDGE[w.data[np.minimum(w.starts, len(w.data) - 1)]] if len(w.data) else 0)
    h, doc = w.hashes(lower=True), w.doc_of_word()
    keep = w.ends > w.starts
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def fit_logistic(row, feature, rows: int, width: int, extra: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 300) -> np.ndarray:
    """Weights of sparse 0/1 features (``row[i]`` has ``feature[i]``), of the dense ``extra`` columns and a constant."""
    weights, m, v = np.zeros(width + extra.shape[1] + 1), 0.0, 0.0
    if not rows:
        return weights
    for t in range(1, rounds + 1):
        z = margin(row, feature, rows, extra, weights)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
        grad = np.concatenate([np.bincount(feature, g[row], width) if len(row) else np.zeros(width), extra.T @ g, [g.sum()]])
        grad[:-1] += ridge / rows * weights[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights = weights - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return weights


def margin(row, feature, rows: int, extra: np.ndarray, weights: np.ndarray) -> np.ndarray:
    width = len(weights) - extra.shape[1] - 1
    sparse = np.bincount(row, weights[feature], rows) if len(row) else np.zeros(rows)
    return sparse + extra @ weights[width:-1] + weights[-1]


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(row, feature, width: int, labels: np.ndarray, folds: int = 5) -> list[np.ndarray]:
    """A model for each column of ``labels``; every later one learns from out-of-fold probabilities of the earlier ones."""
    rows = len(labels)
    fold = np.arange(rows) % folds
    extra, models = np.zeros((rows, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_logistic(row, feature, rows, width, extra, y))
        out = np.zeros(rows)
        for f in range(folds):
            train = np.flatnonzero(fold != f)
            place = np.full(rows, -1)
            place[train] = np.arange(len(train))
            at = place[row] >= 0
            model = fit_logistic(place[row[at]], feature[at], len(train), width, extra[train], y[train])
            out[fold == f] = probability(margin(row, feature, rows, extra, model))[fold == f]
        extra = np.column_stack([extra, out])
    return models


def train(docs: DataFrame, labels: DataFrame, label_cols: list[str], sample: int, wanted: int, least_gain: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Selected word hashes, sorted, and the chain's models. Rows with a null label or id don't train; of repeated ids the largest labels hold."""
    chosen = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *label_cols])).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in label_cols])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` short rows: their bound is the parameter.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id")).select("doc_id", "text", *label_cols)
    # Copies of one text would make each of its words look telling.
    rows = stage(rows.groupBy("text", *label_cols).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", *label_cols), "sample")
    k = len(label_cols)

    def count(batches):
        for b in batches:
            y = np.stack([b.column(2 + c).to_numpy() for c in range(k)], 1).astype(np.int64)
            text = b.column(1).cast(pa.large_string())
            for lo, hi in text_slices(2 << 20, text):
                h, doc = features(text.slice(lo, hi - lo))
                word, inverse = np.unique(h, return_inverse=True)
                sums = [np.bincount(inverse, weights=y[lo + doc, c], minlength=len(word)).astype(np.int64) for c in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(word)).astype(np.int64)), *map(pa.array, sums)],
                                                 names=["h", "n", *[f"p{c}" for c in range(k)]])

    counted = rows.mapInArrow(count, "h long, n long, " + ", ".join(f"p{c} long" for c in range(k)))
    counted = counted.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)]).where("n > 2")
    base = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in label_cols]).first()
    selected = set()
    ranked = []
    for c, label in enumerate(label_cols):
        share = (base[label] or 0) / max(base["n"], 1)
        if 0 < share < 1:
            seen, expect = F.col(f"p{c}"), F.col("n") * share
            other, rest = F.col("n") - seen, F.col("n") * (1 - share)
            term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
            ranked.append(counted.select("h", (term(seen, expect) + term(other, rest)).alias("gain")).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "h").limit(wanted).select("h"))
    for r in ranked:
        selected |= {x["h"] for x in r.collect()}
    words = np.sort(np.array(sorted(selected), np.int64).view(np.uint64))

    def present(batches):
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            for lo, hi in text_slices(2 << 20, text):
                doc, at = known(text.slice(lo, hi - lo), words)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))),
                                                  *[b.column(2 + c).slice(lo, hi - lo).cast(pa.int32()) for c in range(k)]], names=["doc_id", "f", *[f"y{c}" for c in range(k)]])

    data = rows.mapInArrow(present, "doc_id long, f array<int>, " + ", ".join(f"y{c} int" for c in range(k))).toArrow()
    order = np.argsort(mix(data.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable") if data.num_rows else np.zeros(0, int)
    data = data.take(pa.array(order, pa.int64())).combine_chunks()
    lists = data.column("f").to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
    feature = np.array([i for x in lists for i in x], np.int64)
    y = np.stack([data.column(f"y{c}").to_numpy() for c in range(k)], 1) if len(lists) else np.zeros((0, k))
    return words, fit_chain(row, feature, len(words), y)


def scorer(words: np.ndarray, models: list[np.ndarray]):
    """A function from an array of texts to their probabilities, a column for each label; without words nothing is likely."""

    def run(text: pa.Array) -> np.ndarray:
        text, out = text.cast(pa.large_string()), [np.zeros((0, len(models)))]
        for lo, hi in text_slices(1 << 20, text):
            doc, at = known(text.slice(lo, hi - lo), words)
            p = np.zeros((hi - lo, 0))
            for model in models:
                p = np.column_stack([p, probability(margin(doc, at, hi - lo, p, model)) if len(words) else np.zeros(hi - lo)])
            out.append(p)
        return np.concatenate(out)

    return run


def known(text: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and index of each selected word present."""
    h, doc = features(text)
    if not len(words):
        return doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    return doc[hit], at[hit]


def classify(docs: DataFrame, labels: DataFrame, label_cols=("low_quality", "toxic"), id_col: str = "doc_id", text_col: str = "text",
             cutoff: float = 0.3, sample: int = 20000, wanted: int = 1024, least_gain: float = 10.0) -> DataFrame:
    """``(doc_id, p_<label>..., is_<last label>)`` for every row; the last label of the chain is judged at ``cutoff``.

    A null text counts as empty, an empty text gets the models' constants; rows with a null id are scored like others. Repeated rows are
    scored alike. Without telling words (no labelled rows, say) every probability is 0. Extra columns are not carried.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scores = scorer(*train(docs, labels, list(label_cols), sample, wanted, least_gain))
    names = [f"p_{c}" for c in label_cols]

    def run(batches):
        for b in batches:
            p = scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(len(names))], pa.array(p[:, -1] >= cutoff)],
                                             names=["doc_id", *names, f"is_{label_cols[-1]}"])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", is_{label_cols[-1]} boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, label_cols=("low_quality", "toxic"), id_col: str = "doc_id", text_col: str = "text",
               cutoff: float = 0.3, sample: int = 20000, wanted: int = 1024, least_gain: float = 10.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``classify`` doesn't judge positive."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scores = scorer(*train(plain, labels, list(label_cols), sample, wanted, least_gain))

    @F.arrow_udf("boolean")
    def positive(text: pa.Array) -> pa.Array:
        return pa.array(scores(text)[:, -1] >= cutoff)

    return docs.where(~positive(F.coalesce(F.col(text_col), F.lit(""))))
