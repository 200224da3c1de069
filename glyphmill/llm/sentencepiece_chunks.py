"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker behind another character, so no merge crosses from one marked word into the next: each
distinct marked word (its markers, then all up to the next marker) is segmented once, and the ids of a text are the table's ids in the
order of its words. The table lives in a task and is emptied between batches once it holds ``table_chars`` characters; nothing is
shuffled or broadcast but the model file (its size is checked).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import texts
from .words import text_slices

MARK = "▁"
MODEL_LIMIT = 16 << 20


def crosses_marks(model: bytes) -> bool:
    """Whether a piece of the model holds a whitespace marker behind another character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > MODEL_LIMIT:
        raise ValueError("the model is too large to travel with the tasks")
    return model


class ChunkTable:
    """Ids and decoded text of each distinct marked word."""

    def __init__(self, model: bytes, table_chars: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.limit = table_chars
        self.anchor = self.sp.piece_to_id("a")
        self.clear()

    def clear(self):
        self.at, self.decoded, self.held = {}, [], 0
        self.flat, self.lengths = [], []

    def add(self, chunks):
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        if not new:
            return
        # The library puts one marker in front of what it is given, but none in front of an empty text.
        for chunk, ids in zip(new, self.sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)):
            ids = ids or [self.sp.piece_to_id(MARK)]
            self.at[chunk] = len(self.decoded)
            # Behind another piece the first marker stays a space.
            self.decoded.append(self.sp.decode([self.anchor, *ids])[1:])
            self.flat.extend(ids)
            self.lengths.append(len(ids))
            self.held += len(chunk)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids of the batch one after another, the number of each text, the decoded texts."""
        if self.held > self.limit:
            self.clear()
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        flat = [c for chunks in split for c in chunks]
        self.add(flat)
        index = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        lengths = np.asarray(self.lengths, np.int64)
        table, starts = np.asarray(self.flat, np.int32), np.concatenate([[0], np.cumsum(lengths)])
        size = lengths[index] if len(index) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = table[np.repeat(starts[index] - begin[:-1], size) + np.arange(begin[-1])] if len(index) else np.zeros(0, np.int32)
        words = np.concatenate([[0], np.cumsum([len(c) for c in split])])
        decoded, at = [], 0
        for chunks in split:
            decoded.append("".join(map(self.decoded.__getitem__, index[at:at + len(chunks)]))[1:])
            at += len(chunks)
        return ids, np.diff(begin[words]), decoded


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", table_chars: int = 8 << 20) -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` for every row: the library's ids with an end id, and its decoding of them.

    A null text counts as empty: the end id alone and an empty decoded text. Repeated rows and ids stay as they are; extra columns are
    not carried. Raises for a model whose pieces cross whitespace markers.
    """
    if crosses_marks(model):
        raise ValueError("pieces of this model cross whitespace markers")

    def run(batches):
        import sentencepiece

        end = sentencepiece.SentencePieceProcessor(model_proto=model).eos_id()
        chunks = ChunkTable(model, table_chars)
        for b in batches:
            column = b.column(1).cast(pa.large_string())
            for lo, hi in text_slices(1 << 20, column):
                ids, sizes, decoded = chunks.encode(column.slice(lo, hi - lo).to_pylist())
                ends = np.cumsum(sizes)
                flat = np.insert(ids, ends, end)
                offsets = np.concatenate([[0], ends + np.arange(1, hi - lo + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
