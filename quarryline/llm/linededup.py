"""Line deduplication that returns keep bitmaps.

Lines become 128-bit hashes with document and position. One range-partitioned shuffle with a secondary sort by
document and position puts equal lines next to each other; a stream over each partition keeps the first
document's lines and reports the others' positions. Ranges are over hash and document, so that a line that a
third of all documents hold spreads over many partitions; a row per partition then says which document came first for
the hash that a partition starts with. Reported positions become one compressed bitmap per document; texts move
once, to meet their bitmap.

Null and empty texts are one empty line and keep it. Lines of one document (rows that share an id) never count
against each other, a null id is an id of its own, rows repeated in full get the same bitmap. An empty table
gives no rows; other columns are not read by ``bitmaps`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import NULL_ID, free_name, id_in, id_out, materialize, tidy

LEAST_CHARS = 10
STRIP = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_keys(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(h1, h2, k, t, pos) of the lines with a key of at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for b in batches:
            hashes, rows, places = [], [], []
            for row, text in enumerate(b.column(2)):
                t = text.as_py()
                if not t or len(t) < least:
                    continue
                # Case is folded on the whole text; only A-Z change, so lines stay as long as they were.
                low = t.lower() if t.isascii() else t.translate(_LOWER)
                for pos, line in enumerate(low.split("\n")):
                    key = line.strip(STRIP)
                    if len(key) >= least:
                        hashes.append(md5(key.encode(), usedforsecurity=False).digest())
                        rows.append(row)
                        places.append(pos)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            take = np.array(rows, np.int64)
            k, t = b.column(0).to_numpy()[take], b.column(1).to_numpy()[take]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), k, t, np.array(places, np.int32))], ["h1", "h2", "k", "t", "pos"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(id_in(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    return source.mapInArrow(run, "h1 long, h2 long, k long, t long, pos int")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows: those whose document isn't the first of their hash here, and one summary row (kind 1).

    The first hash of a partition may have begun in an earlier one: its first document's rows are reported too,
    as kind 2, and the summary tells who decides.
    """
    part = TaskContext.get().partitionId()
    last: tuple | None = None  # hash and first document of the run that is open
    head: tuple | None = None
    names = ["kind", "part", "h1", "h2", "k", "t", "pos"]

    def rows(kind: int, h1: np.ndarray, h2: np.ndarray, k: np.ndarray, t: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), *map(pa.array, (h1, h2, k, t, pos))], names)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, k, t, pos = (c.to_numpy() for c in b.columns)
        starts = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if last and last[0] == (h1[0], h2[0]):
            starts[0] = False
        if head is None:
            head = (int(h1[0]), int(h2[0]), int(k[0]))
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1  # -1: the run that was open
        firsts = np.r_[k[at], last[1] if last else 0]
        first = firsts[run]
        later = k != first
        if later.any():
            yield rows(0, h1[later], h2[later], k[later], t[later], pos[later])
        same = ~later & (h1 == head[0]) & (h2 == head[1])
        if same.any():
            yield rows(2, h1[same], h2[same], k[same], t[same], pos[same])
        last = ((h1[-1], h2[-1]), first[-1])
    if head is not None:
        # kind 1: the hash and first document at the start; kind 3: those of the run at the end
        for kind, (a, c, d) in ((1, head), (3, (int(last[0][0]), int(last[0][1]), int(last[1])))):
            yield rows(kind, np.array([a]), np.array([c]), np.array([d]), np.array([0], np.int64), np.array([0], np.int32))


@tidy
def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(k, t, pos) of every line to drop."""
    order = ["h1", "h2", "k", "pos"]
    lines = materialize(line_keys(df, id_col, text_col, least), "line-keys")  # else sampling for the ranges would read all texts again
    marked = materialize(
        lines.repartitionByRange("h1", "h2", "k").sortWithinPartitions(*order)
        .mapInArrow(_later, "kind int, part int, h1 long, h2 long, k long, t long, pos int"), "line-marks",
    )
    # Two rows per partition: who was first for the hash that is open where a partition ends.
    ends = marked.filter("kind in (1, 3)").orderBy("part", "kind").collect()
    open_: tuple | None = None
    carried: list[tuple] = []  # partitions that start with a hash some earlier partition began, with its first document
    for r in ends:
        h = (r.h1, r.h2)
        if r.kind == 1:
            if open_ and open_[0] == h:
                carried.append((r.part, r.h1, r.h2, open_[1]))
        elif not open_ or open_[0] != h:
            open_ = (h, r.k)
    out = marked.filter("kind = 0").select("k", "t", "pos")
    if carried:
        spark = df.sparkSession
        heads = spark.createDataFrame(carried, "part int, h1 long, h2 long, first long")  # at most a row per partition
        again = marked.filter("kind = 2").join(F.broadcast(heads), ["part", "h1", "h2"]).filter("k <> first")
        out = out.unionByName(again.select("k", "t", "pos"))
    return out


def _bitmap(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in groups:
        maps, n = [], []
        for x in b.column(2):
            drop = np.asarray(x.values.to_numpy() if hasattr(x, "values") else x.as_py())
            keep = np.ones(int(drop.max()) // 8 * 8 + 8, np.uint8)  # whole bytes: what pads a line count stays 1
            keep[drop] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            n.append(int(len(keep) - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], ["k", "t", "n_dropped", "keep"])


def bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(k, t, n_dropped, keep) of documents that lose lines; ``keep``: zlib of a bit per line, lines past its end stay."""
    drop = dropped_lines(df, id_col, text_col, least)
    # A document's positions are at most its lines; they are collected per document, never per line key.
    return drop.groupBy("k", "t").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmap, "k long, t long, n_dropped long, keep binary")


def apply_bitmap(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text that stays, its lines before and the lines dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    drop = set(np.flatnonzero(bits == 0).tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop)


@tidy
def joined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, extra: list[str] | None = None) -> DataFrame:
    """(k, text, keep, extras) of every row."""
    maps = materialize(bitmaps(df, id_col, text_col, least), "line-bitmaps")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(id_in(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"), F.col(text_col).isNull().alias("absent"), *[F.col(f"`{c}`").alias(f"x_{c}") for c in extra or []])
    return source.join(maps.select("k", "t", "keep").hint("shuffle_hash"), ["k", "t"], "left").drop("t")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    fields = ["k", "n_lines", "n_dropped", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, s = [], [], []
            for text, keep in zip(b.column(1), b.column(2)):
                kept, lines, dropped = apply_bitmap(text.as_py(), keep.as_py())
                n.append(lines)
                d.append(dropped)
                s.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], fields)

    out = joined(df).select("k", "text", "keep").mapInArrow(run, "k long, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(id_out("k").alias("doc_id"), *fields[1:])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``df`` with the lines dropped from its texts; a text that lost nothing stays as it was, null included."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    both, key = joined(df, id_col, text_col, least, others), free_name("k", df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            at = [b.column(names.index(n)) for n in ("text", "keep", "absent")]
            cols = [None if absent.as_py() else t.as_py() if not keep.is_valid else apply_bitmap(t.as_py(), keep.as_py())[0] for t, keep, absent in zip(*at)]
            yield pa.RecordBatch.from_arrays([b.column(names.index("k")), pa.array(cols, pa.string()), *(b.column(names.index(f"x_{c}")) for c in others)], [key, text_col, *others])

    kinds = dict(df.dtypes)
    out = both.mapInArrow(run, ", ".join([f"{key} long", f"`{text_col}` string", *(f"`{c}` {kinds[c]}" for c in others)]))
    return out.select(*(id_out(key).alias(id_col) if c == id_col else F.col(f"`{c}`") for c in df.columns))


__all__ = ["NULL_ID", "apply_bitmap", "bitmaps", "dedup", "digests", "dropped_lines"]
