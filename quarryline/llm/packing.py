"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2`` (matrix work plus attention within the piece). Each
task encodes its documents and buffers the ones shorter than a sequence; whenever the buffer holds
``BLOCK_TOKENS``, its documents go in descending order, each to the sequence of lowest cost with room for it.
A block opens as many sequences as its tokens need; a document that fits nowhere whole is cut across the
cheapest sequences with room, so that a block pads less than one sequence. A document of a sequence or more
first gives full sequences; what is left of it is packed as the others. Nothing is shuffled, and a task holds
one block at a time. Sequence ids are the task's number and a running number, the same when a task is repeated.

Null and empty texts are the end id alone; rows that share an id are packed each for itself; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.bpe import codec
from quarryline.llm.common import NULL_ID, id_in, id_out

LINEAR, QUADRATIC = 1024.0, 1.0
BLOCK_TOKENS = 1 << 21
SCHEMA = "k long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Rooms:
    """Sequences by the room they have left, each room a heap by cost; a tree finds the cheapest with enough room."""

    def __init__(self, capacity: int, n: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int]] = [(float("inf"), -1)] * (2 * self.size)
        self.heaps[capacity] = [(0.0, i) for i in range(n)]
        self._update(capacity)

    def _update(self, room: int) -> None:
        i = room + self.size
        self.tree[i] = (self.heaps[room][0][0], room) if self.heaps[room] else (float("inf"), -1)
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def push(self, room: int, cost: float, seq: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, seq))
            self._update(room)

    def pop(self, least: int) -> tuple[float, int, int] | None:
        """Cost, number and room of the cheapest sequence with at least this room."""
        lo, hi, best = least + self.size, 2 * self.size, (float("inf"), -1)
        while lo < hi:
            if lo & 1:
                best, lo = min(best, self.tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo >> 1, hi >> 1
        if best[1] < 0:
            return None
        cost, seq = heapq.heappop(self.heaps[best[1]])
        self._update(best[1])
        return cost, seq, best[1]


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents shorter than ``capacity``; the number of sequences."""
    n = -(-sum(lengths) // capacity)
    rooms, out = _Rooms(capacity, n), []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[d]
        while left:
            cost, seq, room = rooms.pop(left) or rooms.pop(1)
            take = min(left, room)
            out.append((d, start, take, seq, capacity - room))
            rooms.push(room - take, cost + linear * take + quadratic * take * take, seq)
            start, left = start + take, left - take
    return out, n


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = codec(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        base, seqs = (task.partitionId() if task else 0) << 32, 0
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        held: list[tuple[int, int, int, bytes]] = []  # key, ids before, ids in all, ids
        tokens = 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal seqs, tokens
            pieces, n = assign([len(x[3]) // 4 for x in held], capacity)
            for d, start, length, seq, offset in pieces:
                k, before, total, ids = held[d]
                rows.append((k, before + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, base + seqs + seq, offset))
            seqs += n
            tokens = 0
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = code.encode(text.as_py()) + end
                total, at = len(ids) // 4, 0
                while total - at >= capacity:
                    rows.append((k, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), total, base + seqs, 0))
                    seqs += 1
                    at += capacity
                if total > at:
                    held.append((k, at, total, ids[4 * at :]))
                    tokens += total - at
                if tokens >= block_tokens:
                    flush()
            if rows:
                yield batch()
        if held:
            flush()
        if rows:
            yield batch()

    source = df.select(id_in(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    return source.mapInArrow(run, SCHEMA).select(id_out("k").alias("doc_id"), *names)


__all__ = ["NULL_ID", "assign", "pack"]
