"""Usage logs as a stream: daily counts, and searches joined with the context calls that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.usage import SCHEMA


def events(spark: SparkSession, folder: str, late: str = "15 minutes") -> DataFrame:
    """A stream of the JSON-lines files in a folder, with event time and watermark."""
    lines = spark.readStream.text(folder)
    e = lines.select(F.from_json("value", SCHEMA).alias("e")).filter("e.command is not null and e.ts is not null").select("e.*")
    return e.withColumn("repo", F.coalesce("repo_key", "repo_root", F.lit("(no repo)"))).withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)


def daily(e: DataFrame) -> DataFrame:
    """Events per repo, command and day, once the day is over."""
    return e.groupBy(F.window("at", "1 day").alias("w"), "repo", "command").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "repo", "command", "n")


def followed(searches: DataFrame, contexts: DataFrame, window: str = "15 minutes") -> DataFrame:
    """Searches and later context calls of the same repo within the window (both sides with watermarks)."""
    s = searches.filter("command = 'search'").select(F.col("repo").alias("s_repo"), F.col("at").alias("s_at"), "query")
    c = contexts.filter("command = 'context'").select(F.col("repo").alias("c_repo"), F.col("at").alias("c_at"), "resolved_path")
    return s.join(c, F.expr(f"s_repo = c_repo and c_at >= s_at and c_at <= s_at + interval {window}"))


def once_per_session(e: DataFrame) -> DataFrame:
    """The first event of each repo and session: what is shown once is shown once."""
    return e.withColumn("session", F.col("agent.session")).dropDuplicatesWithinWatermark(["repo", "session"])
