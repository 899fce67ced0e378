"""Versioned tables in a folder: a new snapshot per update, a pointer to the current one, registry and clean-up."""

from __future__ import annotations

import json
import os
import shutil
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, INDEX_VERSION, GRAPH_VERSION = "1", "9", "3"


class Store:
    """Snapshots ``<root>/v<n>/<table>`` and ``<root>/CURRENT``; readers keep the snapshot they opened."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.removeprefix("file://").rstrip("/")
        os.makedirs(self.root, exist_ok=True)

    def current(self) -> int:
        try:
            with open(f"{self.root}/CURRENT") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        path = f"{self.root}/v{version or self.current()}/{table}"
        return self.spark.read.parquet(path) if os.path.exists(path) else None

    def tables(self) -> list[str]:
        return sorted(os.listdir(f"{self.root}/v{self.current()}")) if self.current() else []

    def size(self, table: str) -> int:
        """Bytes of a table of the current snapshot."""
        return sum(os.path.getsize(os.path.join(f, n)) for f, _, ns in os.walk(f"{self.root}/v{self.current()}/{table}") for n in ns)

    def commit(self, tables: dict[str, DataFrame], keep: int = 2) -> int:
        """Write all tables of a new snapshot, then move the pointer in one rename; an error leaves the old one."""
        v = self.current() + 1
        path = f"{self.root}/v{v}"
        shutil.rmtree(path, ignore_errors=True)
        try:
            for name, df in tables.items():
                df.write.parquet(f"{path}/{name}")
        except BaseException:
            shutil.rmtree(path, ignore_errors=True)
            raise
        with open(f"{self.root}/CURRENT.part", "w") as f:
            f.write(str(v))
        os.replace(f"{self.root}/CURRENT.part", f"{self.root}/CURRENT")
        for old in range(1, v - keep + 1):
            shutil.rmtree(f"{self.root}/v{old}", ignore_errors=True)
        return v


def upsert(old: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key the new ones lack, and the new ones."""
    return old.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def changed(old: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """Incoming files that need new chunks: other hash or rounded time, or all if forced."""
    if force:
        return incoming
    o = old.select("path", F.col("hash").alias("_h"), F.round("mtime_ms").alias("_t"))
    same = (F.col("hash") == F.col("_h")) & (F.round("mtime_ms") == F.col("_t"))
    return incoming.join(o, "path", "left").filter(~F.coalesce(same, F.lit(False))).drop("_h", "_t")


def update_files(old: DataFrame, incoming: DataFrame, prefix: str, complete: bool) -> DataFrame:
    """The files after an update: upserts, and deletions below the prefix only if the scan was complete."""
    out = upsert(old, incoming, ["path"])
    if not complete:
        return out
    gone = old.select("path").filter(F.startswith("path", F.lit(prefix))).join(incoming.select("path"), "path", "left_anti")
    return out.join(gone, "path", "left_anti")


def latest(meta: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in meta.columns if c not in key]
    return meta.groupBy(*key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in cols])


def approve(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry (key, root_path, approved_at, updated_at) with approvals merged in; the first approval's time stays."""
    o, n = registry.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return j.select(pick("key"), pick("root_path"), F.coalesce("o.approved_at", "n.approved_at").alias("approved_at"), pick("updated_at"))


def garbage(stores: DataFrame, registry: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, why, bytes): stored keys nobody registered, and registered ones whose folder is gone."""
    orphans = stores.join(registry.select("key"), "key", "left_anti").select("key", F.lit("orphan_db").alias("why"), "bytes")
    gone = registry.join(roots.select("root_path"), "root_path", "left_anti").select("key", "root_path")
    missing = gone.join(stores, "key", "left").select("key", F.lit("missing_root").alias("why"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return orphans.unionByName(missing)


def needs_rebuild(meta: dict[str, str]) -> dict[str, bool]:
    return {"index": meta.get("index_version") != INDEX_VERSION, "graph": meta.get("graph_version") != GRAPH_VERSION, "schema": meta.get("schema_version") != SCHEMA_VERSION}


@contextmanager
def telemetry(path: str, command: str, cap: int = 32 << 20, **fields: object):
    """Appends an event about the block to a JSON-lines log with one older generation; never changes the block's result."""
    event: dict[str, object] = {"v": 1, "command": command, **fields}
    began, outcome = time.time(), "ok"
    try:
        yield event
    except Exception as e:
        outcome = getattr(e, "code", None) or "error"
        event["error_kind"] = type(e).__name__
        raise
    finally:
        try:
            event = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(began)), **event, "outcome": event.get("outcome", outcome), "latency_ms": (time.time() - began) * 1000}
            if os.path.exists(path) and os.path.getsize(path) > cap:
                os.replace(path, path + ".1")
            with open(os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o600), "a") as f:
                f.write(json.dumps(event) + "\n")
        except OSError:
            pass
