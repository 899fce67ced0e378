"""File scans: a folder tree as rows with the decision made on each, and what changed against an earlier scan."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import paths
from quarryline.sources.ignore import ignored_by


RENAMED = {"R", "C"}
#: Entries of a status that leave together.
ITEMS = 10_000


def tree(root: str, prefix: str = "") -> Iterator[tuple[str, int, float]]:
    """(path, size, time in ms) of all files below ``root``, without links; skipped folders are not entered."""
    base = root.removeprefix("file://").rstrip("/")
    for folder, dirs, names in os.walk(base):
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)))
        for d in [d for d in dirs if d in paths.SKIPPED_DIRS]:
            dirs.remove(d)
            yield os.path.relpath(os.path.join(folder, d), base) + "/", 0, 0.0
        for n in sorted(names):
            full = os.path.join(folder, n)
            path = os.path.relpath(full, base)
            if path.startswith(prefix) and not os.path.islink(full):
                s = os.stat(full)
                yield path, s.st_size, s.st_mtime_ns / 1e6


def scan(spark: SparkSession, root: str, prefix: str = "", git: list[str] | None = None, own: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime_ms, language, skip_reason, reused, hash, text) of all files below ``root``, a mounted folder.

    Names, sizes and times come from one listing (Spark's own leaves out names like ``__init__.py``); the tasks read the
    files that stay. Files that ``known`` (path, size, mtime_ms, hash) has with equal size and rounded time are not
    read: their hash is taken over and their text is null. Skipped folders are rows of their own.
    """
    base = root.removeprefix("file://").rstrip("/")
    listed = spark.createDataFrame(list(tree(root, paths.normalize_prefix(prefix))), "path string, size long, mtime_ms double")
    if known is not None:
        k = known.select("path", F.col("size").alias("k_size"), F.col("mtime_ms").alias("k_mtime"), F.col("hash").alias("k_hash"))
        reused = F.coalesce((F.col("size") == F.col("k_size")) & (F.round("mtime_ms") == F.round("k_mtime")), F.lit(False))
        listed = listed.join(k, "path", "left").withColumn("reused", reused).drop("k_size", "k_mtime")
    else:
        listed = listed.withColumn("k_hash", F.lit(None).cast("string")).withColumn("reused", F.lit(False))
    p = F.col("path")
    reason = F.when(p.endswith("/"), "ignored directory").otherwise(paths.skip_reason(p, F.col("size"), None, ignored_by(p, git or [], own or [])))
    listed = listed.withColumn("skip_reason", reason)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = []
            for path, skip, old in f[["path", "skip_reason", "reused"]].itertuples(index=False):
                body = None
                if skip is None and not old:
                    with open(os.path.join(base, path), "rb") as h:
                        body = h.read()
                data.append(body)
            yield f.assign(
                skip_reason=[s if s is not None or b is None or b"\0" not in b else "binary content" for s, b in zip(f["skip_reason"], data)],
                hash=[None if b is None else hashlib.sha256(b).hexdigest() for b in data], text=[None if b is None or b"\0" in b else b.decode("utf-8", "replace") for b in data],
            )

    rows = listed.mapInPandas(read, "path string, size long, mtime_ms double, k_hash string, reused boolean, skip_reason string, hash string, text string")
    kept = F.col("skip_reason").isNull()
    hash_ = F.when(kept, F.when(F.col("reused"), F.col("k_hash")).otherwise(F.col("hash")))
    return rows.select("path", "size", "mtime_ms", F.when(kept, paths.language(p)).alias("language"), "skip_reason", "reused", hash_.alias("hash"), "text")


def skip_histogram(scanned: DataFrame) -> DataFrame:
    return scanned.filter("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): inserted, updated, touched (time alone), unchanged or deleted. Both: path, hash, mtime_ms."""
    o = old.select("path", F.col("hash").alias("o_hash"), F.round("mtime_ms").alias("o_time"))
    n = new.select("path", F.col("hash").alias("n_hash"), F.round("mtime_ms").alias("n_time"))
    change = (
        F.when(F.col("o_hash").isNull(), "inserted").when(F.col("n_hash").isNull(), "deleted")
        .when(F.col("o_hash") != F.col("n_hash"), "updated").when(F.col("o_time") != F.col("n_time"), "touched").otherwise("unchanged")
    )
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def deletions(indexed: DataFrame, seen: DataFrame, prefix: str, complete: Column | bool) -> DataFrame:
    """Indexed paths below the prefix that a scan did not see; none if the scan was incomplete."""
    gone = indexed.select("path").filter(F.startswith("path", F.lit(prefix))).join(seen.select("path"), "path", "left_anti")
    return gone.filter(F.lit(complete) if isinstance(complete, bool) else complete)


def porcelain(df: DataFrame, col: str = "status") -> DataFrame:
    """(path, code, state) of NUL-separated ``git status --porcelain -z`` output, one row per text.

    An entry with R or C is followed by the old name, which is left out. Items are read one after another and leave in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                out, old = [], False
                for x in (text.as_py() or "").split("\0"):
                    if not x:
                        continue
                    if old:
                        old = False
                        continue
                    old = not RENAMED.isdisjoint(x[:2])
                    out.append(x)
                    if len(out) >= ITEMS:
                        yield pa.RecordBatch.from_pydict({"x": out})
                        out = []
                yield pa.RecordBatch.from_pydict({"x": pa.array(out, pa.string())})

    items = df.select(F.col(col).cast("string")).mapInArrow(run, "x string")
    code = F.substring("x", 1, 2)
    state = (
        F.when(F.contains(code, F.lit("D")), "deleted").when(F.contains(code, F.lit("M")), "modified").when(F.contains(code, F.lit("A")), "added")
        .when(F.contains(code, F.lit("R")), "renamed").when(F.contains(code, F.lit("C")), "copied").when(code == "??", "untracked").otherwise("changed")
    )
    return items.select(F.substr("x", F.lit(4)).alias("path"), code.alias("code"), state.alias("state"))


def health(indexed: DataFrame, current: DataFrame, prefix: str, indexed_head: str | None, current_head: str | None, dirty: DataFrame | None = None) -> DataFrame:
    """One row: changed, missing and deleted files, dirty ones, whether the head moved, whether the index is stale."""
    i = indexed.filter(F.startswith("path", F.lit(prefix))).select("path", F.col("hash").alias("a"))
    c = current.filter(F.startswith("path", F.lit(prefix))).select("path", F.col("hash").alias("b"))
    j = i.join(c, "path", "full_outer")
    counts = j.agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("deleted"))
    n_dirty = dirty.filter(F.startswith("path", F.lit(prefix))).agg(F.count(F.lit(1)).alias("dirty")) if dirty is not None else indexed.sparkSession.range(1).select(F.lit(0).cast("long").alias("dirty"))
    moved = bool(indexed_head and current_head and indexed_head != current_head)
    out = counts.join(F.broadcast(n_dirty)).withColumn("head_changed", F.lit(moved))  # one row each
    drift = F.col("changed") + F.col("missing") + F.col("deleted")
    return out.withColumn("stale", (drift > 0) | F.col("head_changed") | (F.lit(bool(indexed_head)) & (F.col("dirty") > 0) & (drift > 0)))


def head_state(current: Column, indexed: Column) -> Column:
    """Whether an index is fresh by its commit alone: the four cases of known and unknown heads."""
    return F.when(current.isNull() & indexed.isNull(), "unversioned").when(current.isNull(), "head_unknown").when(indexed.isNull(), "no_baseline").when(current == indexed, "fresh").otherwise("stale")


def scoped_meta(meta: DataFrame, key: str, prefix: str) -> DataFrame:
    """The value of ``key:prefix``, else of ``key``; empty values count as none."""
    value = F.nullif(F.col("value"), F.lit(""))
    own = F.max(F.when(F.col("key") == (f"{key}:{prefix}" if prefix else key), value))
    return meta.agg(F.coalesce(own, F.max(F.when(F.col("key") == key, value))).alias("value"))
