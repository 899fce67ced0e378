"""Connected components by alternating large-star and small-star steps, wholly distributed.

Every step is an aggregation per node and a join of its edges with one row per node; hubs are kept from
loading one task by ``split_hot_join``. Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, split_hot_join, tidy


def _star_forest(e: DataFrame) -> bool:
    """Whether every node above another one has exactly one below it, which has none below itself."""
    a = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if a.filter("n > 1").take(1):
        return False
    return not e.select(F.col("b").alias("a")).distinct().join(a.select("a"), "a", "left_semi").take(1)


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "star")
    joined = split_hot_join(both.filter("v > u"), least, ["u"], "n")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(e: DataFrame) -> DataFrame:
    least = materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "star")
    joined = split_hot_join(e, least, ["a"], "n")
    turned = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.union(least.select("a", F.col("m").alias("b")))


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that isn't the smallest of its component. edges: (a, b), in any order."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    while not _star_forest(e):
        e = materialize(_small(materialize(_large(e).distinct(), "edges")).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def shared_ids(of: DataFrame) -> DataFrame | None:
    """Links between the classes c of ids k that several classes share, if there are any."""
    shared = of.filter("c is not null").groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("k", "lo")
    edges = materialize(of.join(shared, "k").filter("c <> lo").select(F.col("lo").alias("a"), F.col("c").alias("b")).distinct(), "shared-ids")
    return edges if edges.take(1) else None


def least_ids(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, reached) for the classes in components of several: the smallest id of the component. classes: (c, least, ...)."""
    every = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "c")
    least = every.join(classes.select("c", "least"), "c").groupBy("component").agg(F.min("least").alias("reached"))
    return every.join(least, "component").select("c", "reached")
