"""Dictionary-compressed WARC archives.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary trained on the
records; after it every record is one frame compressed with that dictionary, so that any record can be read
from its offset. Records with equal payloads: the one with the largest id is a response, the others are revisits
(identical-payload-digest profile, without a payload block) that name it.

The dictionary comes from about ``SAMPLE`` records that a hash picks among all pages (at most ``SAMPLE_BYTES``;
``DICT_BYTES`` is its size); these bounds steer compression alone. Each attempt of a task writes archives of its own, of
at most ``ROLL_BYTES`` and a record, renamed when whole; the manifest, itself written, names those of the attempts that
counted, so that a lost executor or a second attempt leaves stray files at worst. Which record is a response is one
aggregation over payload hashes; a payload that a third of all pages share is a hot key, which ``split_hot_join``
keeps from loading one task; pages meet their verdicts by id and hash, in one shuffle, or none if no payload repeats.

Null payloads are empty ones; urls may be null or hold any characters: what a URI can't hold is escaped, and the original
kept in a header. A record's identifier is made of its page's id and its payload's digest. Rows that share an id and a
payload are written each, with the same verdict; those that are responses have one identifier, for one resource.
A null id is written as an absent one and counts as the smallest. An empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import id_in, id_out, materialize, new_dir, posix, split_hot_join, tidy

MAGIC = 0x184D2A5D
DICT_BYTES, SAMPLE_BYTES, SAMPLE = 112 << 10, 8 << 20, 512
ROLL_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f0c8a52-33d5-4e0f-9a53-0c3f6b1f2a77")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _name(page: int | None, sha1: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{"" if page is None else page} {sha1} {kind}')}>"


def record(page: int | None, url: str | None, payload: bytes, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload block; its headers keep the payload's digest and length."""
    body = b"" if kind == "revisit" else payload
    name, shown = "" if page is None else str(page), quote(url or "", safe=":/?#[]@!$&()*+,;=%~'")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page, sha1, kind)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {shown}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-Id: {name}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is None:
        head.append("X-No-Url: 1")
    elif shown != url:
        head.append(f"X-Original-Url: {base64.b64encode(url.encode()).decode()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, sha1, 'response')}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    return fields, rest[:n]


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; too few or too small ones serve as a raw dictionary."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"\0" * 8


class Writer:
    """An archive; ``path`` must be the writer's own, as attempts of one task may run at the same time."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        self.path = path
        self._f = open(f"{path}.part", "wb")  # noqa: SIM115
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self._f.write(struct.pack("<II", MAGIC, len(packed)) + packed)
        self._z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))

    def write(self, data: bytes) -> int:
        """Write a record; the archive's size so far."""
        self._f.write(self._z.compress(data))
        return self._f.tell()

    def close(self) -> None:
        self._f.close()
        os.replace(f"{self.path}.part", self.path)


def read_archive(path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive, by means of the dictionary it holds, one record in memory at a time."""
    with open(path, "rb") as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(f.read(n))))
        at, rest = 8 + n, b""
        while True:
            if not rest:
                rest = f.read(1 << 20)
                if not rest:
                    return
            one, parts, used = z.decompressobj(), [], 0
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    used += len(rest) - len(one.unused_data)
                    rest = one.unused_data
                    break
                used += len(rest)
                rest = f.read(1 << 20)
                if not rest:
                    raise ValueError(f"{path} ends within a record")
            yield at, b"".join(parts)
            at += used


def _sample(pages: DataFrame) -> bytes:
    """A dictionary of about SAMPLE records, picked by a hash among all pages, each cut to its share of SAMPLE_BYTES."""
    every = max(1, pages.count() // SAMPLE)
    most = SAMPLE_BYTES // (4 * SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [record(0, url, html.encode()[: 4 * most], "", "response", None) for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["r"])

    picked = pages.filter(F.pmod(F.xxhash64("k", "url"), F.lit(every)) == 0).select("url", F.substring("html", 1, 4 * most).alias("html"))
    # The limit is for tables of rows repeated in full, which a hash picks together.
    rows = picked.mapInArrow(run, "r binary").limit(2 * SAMPLE).collect()
    return train([bytes(r.r) for r in rows][:SAMPLE])


def verdicts(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(k, ref): for every page the page that responds for its payload, itself included."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    meta = df.select(id_in(id_col).alias("k"), F.unhex(F.sha2(payload, 256)).alias("h"))
    groups = materialize(meta.groupBy("h").agg(F.max("k").alias("ref"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    if not groups.take(1):
        return df.sparkSession.createDataFrame([], "k long, h binary, ref long")
    return split_hot_join(meta, groups, ["h"], "n").filter("ref is not null").select("k", "h", "ref").distinct()


@tidy
def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages; the written manifest: (path, records)."""
    spark = df.sparkSession
    folder = posix(new_dir(spark, "warc"))
    os.makedirs(folder, exist_ok=True)
    pages = df.select(id_in(id_col).alias("k"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    dictionary = spark.sparkContext.broadcast(_sample(pages))  # at most DICT_BYTES
    same = verdicts(df, id_col, payload_col)
    rows = pages.withColumn("h", F.unhex(F.sha2("html", 256))).join(same, ["k", "h"], "left").select("k", "url", "html", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, writer, n = TaskContext.get(), [], None, 0
        for b in batches:
            for k, url, html, ref in zip(*(b.column(i) for i in range(4))):
                page, r, payload = k.as_py(), ref.as_py(), html.as_py().encode()
                if writer is None:
                    writer, n = Writer(f"{folder}/{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.zst", dictionary.value), 0
                kind = "response" if r is None or r == page else "revisit"
                size = writer.write(record(_shown(page), url.as_py(), payload, digest(payload), kind, _shown(r)))
                n += 1
                if size >= ROLL_BYTES:
                    writer.close()
                    made.append((writer.path, n))
                    writer = None
        if writer is not None:
            writer.close()
            made.append((writer.path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([c for _, c in made], pa.int64())], ["path", "records"])

    return materialize(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def _shown(k: int | None) -> int | None:
    return None if k is None or k == -(1 << 63) else k


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of all archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(_records(True), schema)


def _url(h: dict[str, str]) -> str | None:
    if "X-Original-Url" in h:
        return base64.b64decode(h["X-Original-Url"]).decode()
    return None if "X-No-Url" in h else h["WARC-Target-URI"]


def _records(payloads: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        if not payloads:
            kinds = [x for x in kinds if x[0] not in ("url", "payload")]
        rows: list[dict] = []
        size = 0

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])
            rows.clear()
            return out

        for b in batches:
            for path in b.column(0).to_pylist():
                for _, data in read_archive(path):
                    h, body = parse(data)
                    kind = h["WARC-Type"]
                    if kind == "response" and digest(body) != h["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    number = lambda x: int(x) if x and x != "None" else None
                    rows.append({
                        "page_id": number(h["X-Page-Id"]), "url": _url(h), "payload": body if kind == "response" else None,
                        "payload_bytes": len(body) if kind == "response" else int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "record_type": kind, "refers_to": number(h.get("X-Refers-To-Page")),
                    })
                    size += len(body) if payloads else 0
                    if len(rows) >= 5000 or size > 16 << 20:
                        size = 0
                        yield give()
        if rows:
            yield give()

    return run


def index(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records' headers alone: page_id, payload_bytes, payload_digest, record_type, refers_to; payloads are checked against their digests."""
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_records(False), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


__all__ = ["Writer", "id_out", "index", "parse", "read_archive", "read_archives", "record", "verdicts", "write_archives"]
