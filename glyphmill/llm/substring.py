"""Removal of passages that occur earlier: repeated windows of words, found level by level at doubling lengths.

Level one looks at short windows, but only at the least of those inside each full-length window: equal full windows hold the same one
at the same place, so no repeat is lost and an eighth of the windows is shuffled. Windows repeated at one length alone are extended, to
the right and to the left, to twice that length; at the full length every candidate is looked up and all but its first place go. Longer
windows can't change which words go, so the doubling ends there.

Scale: hashes travel packed, dealt out by hash. A task sends one place of each hash it sees, and what it can already tell by itself
goes on without meeting the others, so a passage that fills a third of the corpus arrives once from each task. Texts are dealt out by
chunks of ids once; the exchange is reused by every level of the plan.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import LAST, Chunk, by_chunk, chunk_of, pack, unpack
from .shared import pieces, stage, texts
from .words import U, window_starts, windows, word_hashes

def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of ``width`` values from each position on, the leftmost of equals."""
    at, n, have = np.arange(len(values)), len(values), 1
    while have < width:
        step = min(have, width - have)
        right = at[step:] if step < n else at[:0]
        left = at[:len(right)]
        at = np.concatenate([np.where(values[right] < values[left], right, left), at[len(right):]])
        have += step
    return at


def _send(hashes, doc, place, buckets: int, later: bool):
    """Rows ``(bucket, kind, n, entries)``: kind 0 asks, with one place of each hash; kind 1 carries places already decided."""
    order = np.lexsort((place, doc, hashes))
    hashes, doc, place = hashes[order], doc[order], place[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    again = ~new if later else ~new | np.append(~new[1:], False)
    rows = []
    if again.any():
        d, p = doc[again], place[again]
        by = np.lexsort((p, d))
        rows.append((int(hashes[0] % U(buckets)), 1, len(by), pack(d[by], p[by])))
    h, d, p = hashes[new], doc[new], place[new]
    bucket = (h % U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b, lo, hi in zip(range(buckets), cut[:-1], cut[1:]):
        if hi > lo:
            at = by[lo:hi]
            at = at[np.lexsort((p[at], d[at]))]
            rows.append((b, 0, hi - lo, pack(h[at].view(np.int64), d[at], p[at])))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()),
                     "n": pa.array([r[2] for r in rows], pa.int64()), "entries": pa.array([r[3] for r in rows], pa.binary())})


SENT = "bucket int, kind int, n long, entries binary"
FOUND = "chunk int, n long, places binary"


def _decide(t: pa.Table, chunks: int, later: bool) -> pa.Table:
    """What meets in a bucket: places of hashes that occur more than once, or with ``later`` all but the first place of each hash."""
    kind = t.column("kind").to_numpy()
    ask, known = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
    h, d, p = unpack(ask.column("entries").to_pylist(), ask.column("n").to_pylist(), 3)
    order = np.lexsort((p, d, h))
    h, d, p = h[order], d[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    again = ~new if later else ~new | np.append(~new[1:], False)
    d2, p2 = unpack(known.column("entries").to_pylist(), known.column("n").to_pylist(), 2)
    return _by_chunk(np.concatenate([d[again], d2]), np.concatenate([p[again], p2]), chunks)


def _by_chunk(doc, place, chunks: int) -> pa.Table:
    chunk = chunk_of(doc, chunks)
    order = np.lexsort((place, doc, chunk))
    chunk, doc, place = chunk[order], doc[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else np.zeros(1, int)
    spans = list(zip(cut[:-1], cut[1:]))
    return pa.table({"chunk": pa.array([int(chunk[a]) for a, _ in spans], pa.int32()), "n": pa.array([int(b - a) for a, b in spans], pa.int64()),
                     "places": pa.array([pack(doc[a:b], place[a:b]) for a, b in spans], pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, first: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for every row.

    A word goes if a window of ``length`` words of its document covers it whose words also start earlier: in a smaller id, or in the same
    document. ``length`` is ``first`` doubled at least twice. Kept words are joined by one space. A null or empty text has no words and an
    empty kept text; a null id comes after all others; rows that share an id come in the order of their texts. Texts with fewer than
    ``length`` words are kept whole. Extra columns are not carried.
    """
    levels = [first]
    while levels[-1] < length:
        levels.append(levels[-1] * 2)
    if levels[-1] != length or len(levels) < 3:
        raise ValueError("length must be first doubled at least twice")
    docs = texts(docs, id_col, text_col)
    buckets = chunks = pieces(docs) | 1
    docs = by_chunk(docs, chunks)

    def anchors(batches):
        for b in batches:
            ids = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            hashes, begin = word_hashes(b.column(1))
            full = np.flatnonzero(window_starts(begin, length))
            if len(full):
                short = windows(hashes, first)
                at = np.unique(_least_of(short, length - first + 1)[full])
                row = np.searchsorted(begin, at, "right") - 1
                yield from _send(short[at], ids[row], at - begin[row], buckets, False).to_batches()

    def decide(later):
        return lambda t: _decide(t, chunks, later)

    def decided(sent, later=False):
        return sent.groupBy("bucket").applyInArrow(decide(later), FOUND)

    def found_in(t):
        return unpack(t.column("places").to_pylist(), t.column("n").to_pylist(), 2)

    empty = pa.table({"bucket": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "entries": pa.array([], pa.binary())})

    def doubled(size):
        def run(left, right):
            if not left.num_rows or not right.num_rows:
                return empty
            c = Chunk(left)
            at = c.at(*found_in(right))
            at = np.unique(np.concatenate([at, at - size // 2]))
            at = at[c.inside(at, size)]
            return _send(windows(c.hashes, size)[at], *c.places(at, False), buckets, False) if len(at) else empty
        return run

    def full(left, right):
        if not left.num_rows or not right.num_rows:
            return empty
        c = Chunk(left)
        at = c.at(*found_in(right))
        near = np.zeros(len(c.hashes) + length, np.int64)
        np.add.at(near, np.maximum(at - length // 2, 0), 1)
        np.add.at(near, at + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:len(c.hashes)] > 0) & window_starts(c.first, length))
        return _send(windows(c.hashes, length)[at], *c.places(at, True), buckets, True) if len(at) else empty

    def kept(left, right):
        c = Chunk(left)
        gone = np.zeros(len(c.hashes) + 1, np.int64)
        if right.num_rows:
            at = np.unique(c.twin_at(*found_in(right)))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[c.first]
        out = []
        for row, text in enumerate(c.text):
            words = text.as_py().encode().split()
            if removed[row + 1] > removed[row]:
                words = itertools.compress(words, (~gone[c.first[row]:c.first[row + 1]]).tolist())
            out.append(b" ".join(words).decode())
        return pa.table({"doc_id": c.doc_id, "n_words": pa.array(np.diff(c.first)), "n_removed": pa.array(np.diff(removed)), "kept_text": pa.array(out, pa.string())})

    def over(fn, found, schema):
        return docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(fn, schema)

    found = stage(decided(docs.mapInArrow(anchors, SENT)), "anchors")
    for size in levels[1:-1]:
        found = decided(over(doubled(size), found, SENT))
    found = decided(over(full, found, SENT), later=True)

    def last(left, right):
        return kept(left, right) if left.num_rows else kept(left.slice(0, 0), right.slice(0, 0))

    return over(last, found, "doc_id long, n_words long, n_removed long, kept_text string")
