"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their key (the identifier as 8 big-endian bytes, sign flipped so
that bytes sort as numbers do). Blocks of about ``BLOCK_BYTES`` store each key as the length of the prefix it
shares with the key before it and the rest, then the value (the ids, little-endian, 16-bit if the block's ids
allow it, else 32-bit); each block is one Zstandard frame. Behind the blocks
come a sparse index (first key and place of each block), a Bloom filter over the keys and a footer with their
places, the counts and a checksum. A lookup reads the footer, asks the filter, finds the block by binary search
and reads that block alone.

Writing: one range-partitioned shuffle of the texts and a sort within partitions, then each task encodes its
rows in order and writes shards, of about ``ROLL_BYTES`` at most, under names of its attempt, renamed when whole; the manifest,
itself written, names those of the attempts that counted. A shard's sparse index and 16 bytes a key are in memory.
Rows that share an id stay separate entries, in the order of their texts. Null identifiers come
first and null texts are empty; both come back as they were given (an identifier as null). An empty table
writes no shard.
"""

from __future__ import annotations

import bisect
import itertools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.bpe import codec
from quarryline.llm.common import id_in, id_out, materialize, new_dir, posix, tidy

MAGIC = b"QSST0001"
BLOCK_BYTES, ROLL_BYTES = 64 << 10, 1 << 30
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQI8s")  # index at, bloom at, bloom bytes, blocks, documents, ids, crc of index and bloom, magic


def key_bytes(k: int) -> bytes:
    return struct.pack(">Q", (k + (1 << 63)) & ((1 << 64) - 1))


def key_int(b: bytes) -> int:
    return struct.unpack(">Q", b)[0] - (1 << 63)


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def _bloom(hashes: np.ndarray, bits: int) -> bytes:
    """The filter over keys whose 128-bit hashes are given as pairs (high, low); the places are those of ``_places``."""
    out = np.zeros(bits // 8, np.uint8)
    high, low = hashes.reshape(-1, 2).T
    a, b, most = low % np.uint64(bits), (high | np.uint64(1)) % np.uint64(bits), np.uint64(bits)
    for i in range(BLOOM_HASHES):
        p = (a + np.uint64(i) * b) % most  # bits is far below 2^60: nothing overflows
        np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def write_shard(path: str, rows: Iterator[tuple[int, bytes]]) -> tuple[int, int]:
    """Write sorted (key, ids) rows, up to ROLL_BYTES; the numbers of documents and ids."""
    index: list[tuple[bytes, int, int]] = []
    keys = array("Q")
    docs = ids = 0
    with open(f"{path}.part", "wb") as f:
        block, first, last, size = [], b"", b"", 0
        packer = zstandard.ZstdCompressor(level=1)

        def flush() -> None:
            if block:
                values = [np.frombuffer(v, "<u4") for _, _, v in block]
                wide = max((int(v.max()) for v in values if len(v)), default=0) > 0xFFFF
                kind = "<u4" if wide else "<u2"
                entries = (struct.pack("<BBI", shared, len(rest), len(v)) + rest + v.astype(kind).tobytes() for (shared, rest, _), v in zip(block, values))
                data = packer.compress(bytes([4 if wide else 2]) + b"".join(entries))
                index.append((first, f.tell(), len(data)))
                f.write(data)
                block.clear()

        for k, value in rows:
            key = key_bytes(k)
            if not block:
                first, shared = key, 0
            else:
                shared = len(os.path.commonprefix([last, key]))
            block.append((shared, key[shared:], value))
            size += len(value)
            if key != last:
                x = xxhash.xxh3_128_intdigest(key)
                keys.append(x >> 64)
                keys.append(x & ((1 << 64) - 1))
            last = key
            docs, ids = docs + 1, ids + len(value) // 4
            if size >= BLOCK_BYTES:
                flush()
                size = 0
                if f.tell() >= ROLL_BYTES:
                    break
        flush()
        bloom = _bloom(np.frombuffer(keys, np.uint64), max(64, (len(keys) // 2 * BLOOM_BITS + 7) // 8 * 8))
        packed = b"".join(k + struct.pack("<QI", at, n) for k, at, n in index)
        at = f.tell()
        f.write(packed + bloom)
        f.write(_FOOTER.pack(at, at + len(packed), len(bloom), len(index), docs, ids, zlib.crc32(packed + bloom), MAGIC))
    os.replace(f"{path}.part", path)
    return docs, ids


class Shard:
    """A shard read from its file: ordered iteration and lookups by binary search."""

    def __init__(self, path: str) -> None:
        self._f = open(path, "rb")  # noqa: SIM115
        self._f.seek(-_FOOTER.size, os.SEEK_END)
        at, bloom_at, bloom_n, blocks, self.docs, self.ids, crc, magic = _FOOTER.unpack(self._f.read())
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self._f.seek(at)
        meta = self._f.read(bloom_at - at + bloom_n)
        if zlib.crc32(meta) != crc:
            raise ValueError(f"{path}: index and filter are damaged")
        self._first = [meta[20 * i : 20 * i + 8] for i in range(blocks)]
        self._where = [struct.unpack_from("<QI", meta, 20 * i + 8) for i in range(blocks)]
        self._bloom = meta[bloom_at - at :]

    def close(self) -> None:
        self._f.close()

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self._where[i]
        self._f.seek(at)
        data, p, key = zstandard.ZstdDecompressor().decompress(self._f.read(n)), 1, b""
        width = data[0]
        while p < len(data):
            shared, rest, size = struct.unpack_from("<BBI", data, p)
            p += 6
            key = key[:shared] + data[p : p + rest]
            p += rest
            value = data[p : p + width * size]
            yield key, value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            p += width * size

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for i in range(len(self._where)):
            for key, value in self._block(i):
                yield key_int(key), value

    def maybe(self, k: int) -> bool:
        bits = 8 * len(self._bloom)
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _places(key_bytes(k), bits))

    def get(self, k: int) -> list[bytes]:
        """The ids of all documents with this key."""
        key, out = key_bytes(k), []
        if not self._where or not self.maybe(k):
            return out
        i = max(0, bisect.bisect_left(self._first, key) - 1)
        while i < len(self._where) and self._first[i] <= key:
            out += [v for x, v in self._block(i) if x == key]
            i += 1
        return out


@tidy
def write_shards(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all documents; the folder, and its manifest (shard, piece, path, docs, ids), itself written."""
    spark = df.sparkSession
    out = new_dir(spark, "sstable")
    folder = posix(out)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = codec(tokenizer), struct.pack("<I", end_id)
        task = TaskContext.get()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows() -> Iterator[tuple[int, bytes]]:
            b = first
            while b is not None:
                for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                    yield k, code.encode(text.as_py()) + end
                b = next(batches, None)

        left, made = rows(), []
        for one in left:
            path = f"{folder}/{task.partitionId():08d}-{len(made):04d}-{task.taskAttemptId()}.sst"
            made.append((task.partitionId(), len(made), path, *write_shard(path, itertools.chain((one,), left))))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["shard", "piece", "path", "docs", "ids"])

    source = df.select(id_in(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("k").sortWithinPartitions("k", "text")
    return out, materialize(ordered.mapInArrow(run, "shard long, piece long, path string, docs long, ids long"), "sstable-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A shard's first start is the sum of the ids of the shards before it; the manifest has a row per shard, so
    the sum over it is a window over as many rows as there are files.
    """
    shards = sorted((r.shard, r.piece, r.path, r.ids) for r in manifest.collect())  # a row per file
    before, todo = 0, []
    for _, _, path, ids in shards:
        todo.append((path, before))
        before += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard, rows = Shard(path), []
                for k, value in shard:
                    n = len(value) // 4
                    rows.append((k, start, n, zlib.crc32(value)))
                    start += n
                    if len(rows) >= 20_000:
                        yield _rows(rows)
                shard.close()
                yield _rows(rows)

    if not todo:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(todo, "path string, start long").repartition(len(todo), "path")
    out = files.mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long")
    return out.select(id_out("k").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k", "start", "n_tokens", "ids_crc32"])
