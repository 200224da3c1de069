"""Chunks of documents by id, and arrays packed for the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import word_hashes

LAST = np.iinfo(np.int64).max  # the place of a null id in the order of ids


def pack(*arrays: np.ndarray) -> bytes:
    """Differences of 64-bit integers, byte plane by byte plane, compressed."""
    raw = np.concatenate([np.diff(a.astype(np.int64, copy=False), prepend=0) for a in arrays])
    return pa.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(blobs, sizes, columns: int) -> list[np.ndarray]:
    parts = [[np.zeros(0, np.int64)] for _ in range(columns)]
    for blob, n in zip(blobs, sizes):
        raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
        raw = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
        for c in range(columns):
            parts[c].append(np.cumsum(raw[c * n:(c + 1) * n]))
    return [np.concatenate(p) for p in parts]


def chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 13) ^ (doc >> 29), chunks)


def by_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """``docs`` with a ``chunk`` column, the same as ``chunk_of`` gives."""
    place = F.expr(f"cast(pmod(shiftright(d, 29) ^ shiftright(d, 13) ^ d, {chunks}) as int)")
    return docs.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("chunk", place).drop("d")


def _one(t: pa.Table, name: str) -> pa.Array:
    column = t.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Chunk:
    """The documents of a chunk in the order of their ids; rows that share an id are told apart by their text."""

    def __init__(self, t: pa.Table, lower: bool = False):
        self.table = t = t.combine_chunks()
        ids = _one(t, "doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.twins = len(ids) > 1 and bool((np.diff(ids[order]) == 0).any())
        if self.twins:
            text = t.column("text").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda r: (ids[r], text[r])))
        self.ids = ids[order]
        self.doc_id = _one(t, "doc_id").take(pa.array(order))
        self.text = _one(t, "text").cast(pa.large_string()).take(pa.array(order))
        self.order = order
        self.hashes, self.first = word_hashes(self.text, lower)
        begin = np.searchsorted(self.ids, self.ids)
        self.twin = np.arange(len(self.ids)) - begin

    def at(self, doc, place) -> np.ndarray:
        """Word indexes of places, of every row with that id."""
        out, row, last = [], np.searchsorted(self.ids, doc), np.searchsorted(self.ids, doc, "right")
        while (live := row < last).any():
            doc, place, row, last = doc[live], place[live], row[live], last[live]
            out.append(self.first[row] + place)
            row = row + 1
        return np.unique(np.concatenate([np.zeros(0, np.int64), *out]))

    def places(self, index, with_twin: bool):
        row = np.searchsorted(self.first, index, "right") - 1
        place = index - self.first[row]
        return self.ids[row], place + (self.twin[row] << 32 if with_twin else 0)

    def twin_at(self, doc, place) -> np.ndarray:
        """Word indexes of places that name one row of an id."""
        return self.first[np.searchsorted(self.ids, doc) + (place >> 32)] + (place & 0xFFFFFFFF)

    def inside(self, start, size: int) -> np.ndarray:
        row = np.searchsorted(self.first, start, "right") - 1
        return (start >= 0) & (start >= self.first[np.maximum(row, 0)]) & (start + size <= self.first[np.minimum(row + 1, len(self.first) - 1)])
