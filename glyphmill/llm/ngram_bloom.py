"""Bigram scoring from a log-frequency Bloom filter.

A bigram whose count reaches the j-th of the levels 1, 2, 3, 4, 5, 8, 11, 16, ... (powers of the root of 2, rounded down) is entered
once for each level it reaches. Scoring probes level after level until one is missing; the last one present is the count, never above
the exact counts of both words. The probability of a token is interpolated:

    p(w | v) = weight * count(v, w) / count(v) + (1 - weight) * (count(w) + 0.5) / (N + 0.5 * (V + 1))

Rounded-down counts keep the sum over w at most 1. Counts of words are exact: they come from a vocabulary table over all training texts,
looked up for the distinct words of a chunk of documents at a time.

Scale: a filter has at most ``most_bits`` bits, so what is broadcast has a fixed bound. It gets ``bits_per_byte`` bits for each byte of
text; a corpus that needs more is split into shards by a hash of the bigram. Each shard is one pass with its own filter over the texts, and
the parts of a text's score, one for each shard, are added up. Tasks add up counts before the shuffle, so common words and bigrams
arrive once from each slab of texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Chunk, by_chunk, pack, unpack
from .shared import partitions, stage
from .words import BASE, U, mix, text_slices, word_hashes

END = U(0x2545F4914F6CDD1D)
SEGMENTS, PROBES = 256, 4
LEVELS = np.unique(np.floor(2.0 ** (np.arange(126) / 2))).astype(np.int64)


def tokens(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end behind each text, and where each text begins."""
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def pairs(token: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the end of the last text stands before a first word."""
    with np.errstate(over="ignore"):
        return mix(np.concatenate([[END], token[:-1]])[:len(token)] * BASE + token)


def split(pair: np.ndarray, shards: int):
    """Segment over all shards, and the rest of the hash."""
    parts = U(SEGMENTS * shards)
    return (pair % parts).astype(np.int64), (pair // parts) & U((1 << 36) - 1)


def _bits(name: np.ndarray, level: int, segment_bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(name + U(level) * BASE)
    a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    return [((a + U(i) * b) & U(segment_bits - 1)).astype(np.int64) for i in range(PROBES)]


def enter(name: np.ndarray, count: np.ndarray, segment_bits: int) -> np.ndarray:
    """The bytes of one segment with all levels of its bigrams."""
    bits = np.zeros(segment_bits, bool)
    for level, least in enumerate(LEVELS.tolist(), 1):
        name, count = name[count >= least], count[count >= least]
        if not len(name):
            break
        for at in _bits(name, level, segment_bits):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def look_up(data: np.ndarray, segment: np.ndarray, name: np.ndarray, most: np.ndarray, segment_bits: int) -> np.ndarray:
    """Counts found by probing level after level, at most ``most``."""
    out, live = np.zeros(len(name), np.int64), np.flatnonzero(most > 0)
    for level, least in enumerate(LEVELS.tolist(), 1):
        live = live[most[live] >= least]
        for i in range(PROBES):
            if not len(live):
                return out
            at = _bits(name[live], level, segment_bits)[i]
            live = live[(data[segment[live] * (segment_bits // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
        out[live] = least
    return out


def _add_up(key, count):
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[at], np.add.reduceat(count, at) if len(at) else count


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.25, bits_per_byte: float = 0.6,
          most_bits: int = 1 << 29) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row; learns from rows where the column
    ``held_out`` isn't true.

    A-Z count as a-z; each text is its words and one end. ``base_score`` is the add-half unigram log10 probability, ``score`` the model's.
    A null or empty text is one end token; rows with a null id are kept, with whatever ``held_out`` gives (null: not held out). Repeated
    rows count as often as they occur. Without training texts both scores are 0. Extra columns are not carried.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets, chunks = parts, 4 * parts + 1
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(size * bits_per_byte / most_bits))
    bits = max(1 << 20, min(most_bits, 1 << math.ceil(math.log2(max(1.0, size * bits_per_byte / shards)))))
    segment_bits = bits // SEGMENTS
    sent = "kind int, bucket int, n long, entries binary"

    def rows_of(kind, bucket, keys, counts):
        order = np.lexsort((keys, bucket))
        bucket, keys, counts = bucket[order], keys[order], counts[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
        return [(kind, int(bucket[a]), int(b - a), pack(keys[a:b].view(np.int64), counts[a:b])) for a, b in zip(cut[:-1], cut[1:])]

    def count(batches):
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            for lo, hi in text_slices(4 << 20, text):
                token, _ = tokens(*word_hashes(text.slice(lo, hi - lo), True))
                word, n = np.unique(token, return_counts=True)
                rows = rows_of(0, (word % U(buckets)).astype(np.int64), word, n)
                pair, n = np.unique(pairs(token), return_counts=True)
                segment, name = split(pair, shards)
                rows += rows_of(1, segment, name, n)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["kind", "bucket", "n", "entries"])

    def gather(key, t):
        kind, bucket = key[0].as_py(), key[1].as_py()
        keys, counts = unpack(t.column("entries").to_pylist(), t.column("n").to_pylist(), 2)
        keys, counts = _add_up(keys.view(U), counts)
        data = pack(keys.view(np.int64), counts) if kind == 0 else enter(keys, counts, segment_bits).tobytes()
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64()), "data": pa.array([data], pa.binary())})

    known = stage(docs.where(~F.col("held_out")).select("text").mapInArrow(count, sent).groupBy("kind", "bucket")
                  .applyInArrow(gather, "kind int, bucket int, n long, total long, data binary"), "counts")
    vocabulary = known.where("kind = 0").select("bucket", "n", "data")
    sums = known.where("kind = 0").agg(F.sum("total").alias("total"), F.sum("n").alias("types")).first()
    total, types = sums["total"] or 0, sums["types"] or 0
    documents = by_chunk(docs, chunks)

    def distinct(token):
        word, inverse = np.unique(token, return_inverse=True)
        bucket = (word % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return word, inverse, bucket, order

    def ask(t):
        c = Chunk(t, True)
        word, _, bucket, order = distinct(tokens(c.hashes, c.first)[0])
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        spans = [(b, lo, hi) for b, lo, hi in zip(range(buckets), cut[:-1], cut[1:]) if hi > lo]
        chunk = t.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([s[0] for s in spans], pa.int32()), "chunk": pa.array([chunk] * len(spans), pa.int32()),
                         "n": pa.array([int(s[2] - s[1]) for s in spans], pa.int64()), "entries": pa.array([pack(word[order[s[1]:s[2]]].view(np.int64)) for s in spans], pa.binary())})

    def answer(left, right):
        word, n = unpack(right.column("data").to_pylist(), right.column("n").to_pylist(), 2)
        word = word.view(U)
        out = []
        for blob, k in zip(left.column("entries").to_pylist(), left.column("n").to_pylist()):
            want = unpack([blob], [k], 1)[0].view(U)
            at = np.minimum(np.searchsorted(word, want), max(len(word) - 1, 0))
            out.append(pack(np.where(word[at] == want, n[at], 0) if len(word) else np.zeros(k, np.int64)))
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "n": left.column("n"), "counts": pa.array(out, pa.binary())})

    answers = documents.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, n long, entries binary").groupBy("bucket").cogroup(
        vocabulary.groupBy("bucket")).applyInArrow(answer, "chunk int, bucket int, n long, counts binary")
    columns = "doc_id long, chunk int, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def scored(shard, data):
        def run(left, right):
            c = Chunk(left, True)
            token, begin = tokens(c.hashes, c.first)
            if not len(token):
                return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("chunk", pa.int32()), ("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
            word, inverse, _, order = distinct(token)
            got = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("counts").to_pylist()))
            counts = np.zeros(len(word), np.int64)
            counts[order] = unpack([g[2] for g in got], [g[1] for g in got], 1)[0]
            n = counts[inverse]
            end = counts[np.searchsorted(word, END)]
            before = np.concatenate([[end], n[:-1]])
            segment, name = split(pairs(token), shards)
            mine = segment // SEGMENTS == shard
            seen = look_up(np.frombuffer(data.value, np.uint8), segment - shard * SEGMENTS, name, np.where(mine, np.minimum(n, before), 0), segment_bits)
            plain = (n + 0.5) / (total + 0.5 * (types + 1))
            p = np.where(before > 0, weight * seen / np.maximum(before, 1) + (1 - weight) * plain, plain)
            part = np.where(mine, np.log10(p), 0.0)
            at = begin[:-1]
            rows = np.arange(len(at))
            held = left.column("held_out").combine_chunks().take(pa.array(c.order))
            return pa.table({"doc_id": c.doc_id, "chunk": pa.array(np.full(len(at), left.column("chunk")[0].as_py(), np.int32)), "row": pa.array(rows), "held_out": held,
                             "n_tokens": pa.array(np.diff(begin)), "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64), at)),
                             "base_score": pa.array(np.add.reduceat(np.log10(plain), at)), "score": pa.array(np.add.reduceat(part, at))})
        return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, columns)

    out = None
    for shard in range(shards):
        lo = shard * SEGMENTS
        found = {r["bucket"]: r["data"] for r in known.where(f"kind = 1 and bucket >= {lo} and bucket < {lo + SEGMENTS}").select("bucket", "data").collect()}
        none = bytes(segment_bits // 8)
        data = spark.sparkContext.broadcast(b"".join(bytes(found.get(lo + k, none)) for k in range(SEGMENTS)))
        del found
        part = scored(shard, data)
        out = part if out is None else out.unionByName(part)
    if shards > 1:
        out = out.groupBy("chunk", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")], F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
