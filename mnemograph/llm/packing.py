"""Harmonic packing: reciprocal-capacity classes, each worker fills its own bins.

A document's ids are cut into whole sequences of ``capacity``; the rest gives pieces of 1/2, 1/4 and
1/8 of it while they fit, then a tail. A piece of length t is of class k = capacity // t, and a bin
of class k closes with exactly k pieces, so a bin of the halving classes is full and a bin of tails
at least k/(k+1) full. Each worker (partition) packs alone in one pass and keeps less than one bin a
class. At its end it joins the pieces of its open bins, cuts them at the capacity and so leaves one
sequence that may need padding.

Defined cases: a null or empty text is its end id alone; null and repeated doc_ids are packed as
rows of their own; an empty table gives no pieces; other columns are ignored. A sequence whose
content is a power of two long needs no padding; others are padded to ``capacity``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemograph.llm.common import two

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces_of(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    at = 0
    while total - at >= capacity:
        yield at, capacity
        at += capacity
    for part in (2, 4, 8):
        if total - at >= capacity // part:
            yield at, capacity // part
            at += capacity // part
    if total > at:
        yield at, total - at


class Packer:
    """The bins of one worker. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence, self.open, self.out = capacity, first_sequence, {}, []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset, ids))
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        for start, length in pieces_of(total, self.capacity):
            k = self.capacity // length
            waiting = self.open.setdefault(k, [])
            waiting.append((doc_id, start, ids[4 * start : 4 * (start + length)], total))
            if len(waiting) == k:
                self._close(waiting)
                self.open[k] = []

    def finish(self) -> None:
        fill, room = [], self.capacity
        for k in sorted(self.open):
            for doc_id, start, ids, total in self.open[k]:
                while ids:
                    head, ids = ids[: 4 * room], ids[4 * room :]
                    fill.append((doc_id, start, head, total))
                    start, room = start + len(head) // 4, room - len(head) // 4
                    if not room:
                        self._close(fill)
                        fill, room = [], self.capacity
        if fill:
            self._close(fill)
        self.open = {}

    def take(self, with_ids: bool) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [[]] * 8
        names = [x.split()[0] for x in PIECES.split(", ")]
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols[7]])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cols[7]), dtype="<i4"))))
            names.append("ids")
        self.out = []
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(df: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", spaces: str = "joined", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cache_bytes: int = 240 << 20) -> DataFrame:
    """One row a piece: where it stands in its document and in its sequence; ``ids`` if asked for.

    ``cache_bytes``: what a worker may hold of words' ids; less costs time and changes no result.
    """
    if capacity < 8 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, 8 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from mnemograph.llm.tokens import cached

        tok, end = cached(tokenizer, spaces, cache_bytes), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # texts and pieces of few rows at a time
                part = batch.slice(lo, 500)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, tok.encode(text) + end)
                    if len(packer.out) >= 1000:
                        yield packer.take(with_ids)
        packer.finish()
        yield packer.take(with_ids)

    return two(df, id_col, text_col).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
