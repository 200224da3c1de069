"""Words, word hashes and window hashes of whole Arrow batches of texts, without a loop over words.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; in UTF-8 these never occur inside another character.
Hashes are 64-bit: a polynomial over table values of the bytes modulo 2**64, then mixed. They travel as signed 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with every output bit depending on every input bit."""
    x = x.astype(U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            step = U(pow(int(base), have, 1 << 64))
            take = min(have, n - have)
            out[have:have + take] = out[:take] * step
            have += take
    return out[:n]


class Words:
    """Words of a batch: ``starts``/``ends`` in ``data`` (bytes), and ``first``: where each document's words begin (one more than documents)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        size = len(data)
        inside = np.zeros(size + 1, bool)
        inside[:size] = ~_SPACE[data]
        # A word also starts where a document starts, and ends where it ends.
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[:-1]
        starts[edge] = inside[edge]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(starts[:size])
        ends = inside[:size] & ~inside[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = inside[last]
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word; with ``lower`` A-Z count as a-z."""
        size = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            value = (_BYTE_LOWER if lower else _BYTE)[self.data]
            value *= _powers(BASE, size)
            total = np.zeros(size + 1, U)
            np.cumsum(value, out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * _powers(INVERSE, size)[self.starts] + (self.ends - self.starts).astype(U))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_hashes(text: pa.Array, lower: bool = False, batch_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of any size, and where each text's begin (one more than texts)."""
    hashes, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    text = text.cast(pa.large_string())
    for lo, hi in text_slices(batch_bytes, text):
        w = Words(text.slice(lo, hi - lo))
        hashes.append(w.hashes(lower))
        counts.append(w.counts)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` hashes from each position on; positions within the last ``size - 1`` hold garbage."""
    n = len(hashes)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        powers = [U(pow(int(BASE), k + 1, 1 << 64)) for k in range(size)]
        for k in range(min(size, n)):
            out[:n - k] += hashes[k:] * powers[k]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """True where a window of ``size`` words that starts there stays inside its document."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left >= size


def text_slices(batch_bytes: int, texts: pa.Array):
    """(from, to) ranges of rows with about ``batch_bytes`` of text, one row at least."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + batch_bytes, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
