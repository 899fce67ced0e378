"""The file graph: degrees, modules, neighbours, shortest paths, cycles. Edges are (src, dst, kind, ...)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarryline.functions import paths

#: Steps of an iteration between written tables.
HOPS = 4
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarryline-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = "file://" + _own[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and what is read more than once is made once."""
    path = f"{shared_dir(df.sparkSession)}/quarryline/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, inbound, outbound, total), zeros for files without edges."""
    ends = edges.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    n = ends.groupBy("path").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    out = files.select("path").join(n, "path", "left").fillna(0, ["inbound", "outbound"])
    return out.withColumn("total", F.col("inbound") + F.col("outbound"))


def top_degree(degree: DataFrame, limit: int | None = 10, bridges: bool = False) -> DataFrame:
    """Files by degree, all of them without a limit; bridges have edges in both directions."""
    keep = (F.col("inbound") > 0) & (F.col("outbound") > 0) if bridges else F.col("total") > 0
    out = degree.filter(keep).orderBy(F.desc("total"), F.desc("inbound"), F.desc("outbound"), "path")
    return out if limit is None else out.limit(limit)


def isolated(files: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    return files.select("path").join(ends, "path", "left_anti")


def modules(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, files, edges): an edge counts for its source's module, and for its target's if that is another one."""
    m = files.select(paths.module(F.col("path")).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("files"))
    both = F.array_distinct(F.array(paths.module(F.col("src")), paths.module(F.col("dst"))))
    e = edges.select(F.explode(both).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("edges"))
    return m.join(e, "module", "left").fillna(0, ["edges"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Steps in both directions: (src, dst, step)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("reverse_"), F.col("kind")).alias("step"))
    return edges.select("src", "dst", F.col("kind").alias("step")).unionByName(back)


def neighbours(targets: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """(target, step, path, rank): the first ``limit`` of each direction and kind, in the order of lines, then paths."""
    near = adjacency(edges.select("src", "dst", "kind")).withColumnRenamed("src", "target").withColumnRenamed("dst", "path").filter("target <> path").distinct()
    j = near.join(targets.select("target").distinct(), "target")
    rank = F.row_number().over(W.partitionBy("target", "step").orderBy("path"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= limit)


def shortest_paths(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(start, path, hops, trail): files within ``hops`` steps in either direction, by rounds that leave out what was reached.

    trail: the files of a shortest path, of several the first in order.
    """
    hops = max(1, min(hops, 4))
    step = adjacency(edges.select("src", "dst", "kind")).select("src", F.col("dst").alias("next")).distinct()
    reached = starts.select("start", F.col("start").alias("path"), F.lit(0).alias("hops"), F.array("start").alias("trail")).distinct()
    front = reached
    for h in range(1, hops + 1):
        nxt = front.join(step, front.path == step.src).groupBy("start", F.col("next").alias("path")).agg(F.min(F.concat("trail", F.array("next"))).alias("trail"))
        front = cut(nxt.join(reached.select("start", "path"), ["start", "path"], "left_anti").select("start", "path", F.lit(h).alias("hops"), "trail"))
        reached = reached.unionByName(front)
    return reached


def _ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(n): nodes where a walk of ``HOPS`` edges from ``a`` to ``b`` ends; each step has the one before once, so that plans stay short."""
    out = edges.select(F.col(b).alias("n")).distinct()
    for _ in range(HOPS - 1):
        out = edges.join(out, F.col(a) == F.col("n"), "left_semi").select(F.col(b).alias("n")).distinct()
    return out


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their smallest node.

    Trim and colour: nodes without incoming or outgoing edges go, again and again; then every node takes the
    smallest node that reaches it, and those that reach that one back form a component; it leaves, and so on.
    Every node also leads to itself, so that a step keeps what it starts from without reading it twice.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    done: DataFrame | None = None
    n = e.count()
    while n:
        while True:
            for a, b in (("src", "dst"), ("dst", "src")):
                e = cut(e.join(_ends(e, a, b), F.col(a) == F.col("n"), "left_semi"))
            before, n = n, e.count()
            if n == before:
                break
        if not n:
            break
        colour = cut(e.select(F.col("src").alias("n")).distinct().withColumn("c", F.col("n")))
        loops = cut(e.unionByName(colour.select(F.col("n").alias("src"), F.col("n").alias("dst"))))
        while True:
            pushed = colour
            for _ in range(HOPS):
                pushed = loops.join(pushed, F.col("src") == F.col("n")).groupBy(F.col("dst").alias("n")).agg(F.min("c").alias("c"))
            pushed = cut(pushed)
            moved = pushed.join(colour.withColumnRenamed("c", "old"), "n").filter("c <> old").limit(1).count()
            colour = pushed
            if not moved:
                break
        back = cut(colour.filter("n = c").select("n", "c"))
        within = cut(loops.join(colour.withColumnRenamed("n", "src"), "src").withColumnRenamed("c", "cs").join(colour.withColumnRenamed("n", "dst"), "dst").filter("cs = c").select("src", "dst", "c"))
        have = back.count()
        while True:
            for _ in range(HOPS):
                back = within.join(back.select(F.col("n").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("n"), "c").distinct()
            back = cut(back)
            more = back.count()
            if more == have:
                break
            have = more
        found = back.select(F.col("n").alias("node"), F.col("c").alias("component"))
        done = found if done is None else done.unionByName(found)
        gone = back.select("n")
        e = cut(e.join(gone.withColumnRenamed("n", "src"), "src", "left_anti").join(gone.withColumnRenamed("n", "dst"), "dst", "left_anti").select("src", "dst"))
        n = e.count()
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    many = done.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    return done.join(many, "component").select("node", F.col("first").alias("component"))


def cycle_list(members: DataFrame, limit: int | None = None) -> DataFrame:
    """(component, size, paths): cycles by size, then by their first file. members: ``cycles``."""
    out = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("paths")).orderBy(F.desc("size"), "component")
    return out if limit is None else out.limit(limit)
