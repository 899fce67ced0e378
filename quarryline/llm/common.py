"""Shared plumbing: ids that may be null, the shared folder, written cut points, Arrow loops."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier inside a plan (it sorts first, as null does) and turns back into null at the end.
NULL_ID = -(1 << 63)
#: Set while a table is written: its shuffle files go as soon as it is there.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; only a session without one (tests) gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarryline-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = "file://" + _own[0]
    return found.rstrip("/")


def posix(path: str) -> str:
    """The path of a shared folder for plain file calls; the folder has to be a mounted one."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: this operator writes files itself and needs a mounted shared folder")
    return path.removeprefix("file://").removeprefix("file:")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quarryline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a DataFrame of its own, so that the setting holds for its plan
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    if "://" not in path or path.startswith("file://"):
        shutil.rmtree(posix(path), ignore_errors=True)
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(f: Callable) -> Callable:
    """Deletes the tables that a call of ``f`` wrote, but for those that the DataFrames it returns read.

    Calls may nest: what an inner call's result reads goes to the outer call's account.
    """

    @functools.wraps(f)
    def run(*args: object, **named: object) -> object:
        _open.append([])
        try:
            out = f(*args, **named)
        finally:
            written = _open.pop()
        results = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        frames = [x for x in (*results, *args, *named.values()) if isinstance(x, DataFrame)]
        if frames and written:
            used = {os.path.dirname(p).rsplit("/", 1)[-1] for x in results for p in x.inputFiles()}
            for path in written:
                if path.rsplit("/", 1)[-1] not in used:
                    _delete(frames[0].sparkSession, path)
                elif _open:
                    _open[-1].append(path)
        return out

    return run


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/quarryline/" in f:
            _delete(df.sparkSession, f)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NULL_ID))


def free_name(name: str, taken: list[str]) -> str:
    """A column name that a table doesn't have yet."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def split_hot_join(left: DataFrame, right: DataFrame, key: list[str], weight: str, share: int = 1024) -> DataFrame:
    """Left join of many rows with one row per key, safe when one key holds a large part of the rows.

    ``right`` (already written) says in ``weight`` how many left rows a key has. Fewer than ``share`` keys can
    hold more than a ``share``-th of all rows each, which bounds what is broadcast; the rest joins by shuffle.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // share, 1000)
    hot = right.filter(F.col(weight) > limit)
    if total <= 1000:
        return left.join(right, key, "left")
    if not hot.take(1):
        return left.join(right.hint("merge"), key, "left")
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cols = [c for c in right.columns if c not in key]
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot", *cols).join(right.filter(F.col(weight) <= limit).hint("merge"), key, "left")
    return tagged.filter(F.col("_hot")).drop("_hot").unionByName(rest)
