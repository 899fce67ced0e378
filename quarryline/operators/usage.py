"""Usage logs: reading, overview, outcomes, funnels, joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarryline.functions.text import round_up

SCHEMA = (
    "v int, ts string, tool_version string, command string, adapter string, latency_ms double, outcome string, repo_key string, repo_root string, cwd string, path_prefix string, error_kind string, "
    "agent struct<ppid_chain:string,harness:string,session:string>, query string, result_count int, top_score double, top_hit_confidence string, stale boolean, cap_hit boolean, "
    "results array<struct<path:string,score:double,kind:string,language:string>>, target string, target_form string, resolved_path string, read_first_count int, approve boolean, duration_ms double, "
    "scanned int, indexed int, skipped int, removed int, completed boolean"
)
MINUTES_15 = 15 * 60 * 1000


def read(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events, counts): events of JSON lines, and one row with the numbers of lines and malformed ones."""
    lines = spark.read.text(files).filter(F.trim("value") != "")
    e = lines.withColumn("ok", F.try_parse_json("value").isNotNull()).withColumn("e", F.from_json("value", SCHEMA))
    good = F.col("ok") & F.col("e.command").isNotNull() & F.col("e.ts").isNotNull()
    counts = e.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.coalesce(good, F.lit(False))).alias("malformed"))
    return e.filter(good).select("e.*"), counts


def prepare(events: DataFrame) -> DataFrame:
    """Adds ``repo`` and ``ms``; ``seq`` breaks ties of time and has to be there."""
    repo = F.coalesce("repo_key", "repo_root", F.lit("(no repo)"))
    return events.withColumn("repo", repo).withColumn("ms", F.unix_millis(F.to_timestamp("ts")))


def only(events: DataFrame, repo: str | None = None, since: str | None = None) -> DataFrame:
    out = events
    if repo:
        out = out.filter((F.col("repo_key") == repo) | (F.col("repo_root") == repo))
    return out.filter(F.col("ts") >= since) if since else out


def overview(e: DataFrame) -> DataFrame:
    return e.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("repo").alias("repos"), F.count_distinct("agent.ppid_chain").alias("agents"),
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
    )


def histograms(e: DataFrame) -> DataFrame:
    """(dimension, value, n) by command, adapter, harness and version, in one pass over grouping sets."""
    rows = e.select(F.explode(F.array(
        F.struct(F.lit("command").alias("dimension"), F.coalesce("command", F.lit("(unknown)")).alias("value")), F.struct(F.lit("adapter").alias("dimension"), F.coalesce("adapter", F.lit("unknown")).alias("value")),
        F.struct(F.lit("harness").alias("dimension"), F.col("agent.harness").alias("value")), F.struct(F.lit("version").alias("dimension"), F.coalesce("tool_version", F.lit("(unknown)")).alias("value")),
    )).alias("x"))
    return rows.select("x.*").filter("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def per_repo(e: DataFrame, by: Column) -> DataFrame:
    return e.groupBy("repo", by.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def nearest_rank(p: float, col: str) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")


def rate(cond: Column) -> Column:
    """Share of rows, four digits; 0 if there are none."""
    return F.coalesce(round_up(F.count_if(cond) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0))


def outcomes(e: DataFrame) -> DataFrame:
    return e.groupBy("command").agg(
        F.count(F.lit(1)).alias("total"), nearest_rank(0.5, "latency_ms").alias("p50"), nearest_rank(0.95, "latency_ms").alias("p95"),
        rate(F.col("outcome") == "empty").alias("empty_rate"), rate(F.coalesce("cap_hit", F.lit(False))).alias("cap_rate"), rate(F.coalesce("stale", F.lit(False))).alias("stale_rate"),
        nearest_rank(0.5, "top_score").alias("top_score_p50"), rate(F.coalesce("approve", F.lit(False))).alias("approve_rate"), nearest_rank(0.5, "duration_ms").alias("duration_p50"), nearest_rank(0.95, "duration_ms").alias("duration_p95"),
    )


def outcome_counts(e: DataFrame, col: str) -> DataFrame:
    return e.filter(F.col(col).isNotNull()).groupBy("command", col).agg(F.count(F.lit(1)).alias("n"))


def gate_funnel(e: DataFrame) -> DataFrame:
    """Repos that met the gate, then approved, then searched: one row per repo decides, its last search is enough."""
    r = e.groupBy("repo").agg(
        F.min(F.when(F.col("outcome") == "not_approved", F.col("ms"))).alias("gate"), F.count_if(F.col("outcome") == "not_approved").alias("events"),
        F.min(F.when((F.col("command") == "index") & F.coalesce("approve", F.lit(False)), F.col("ms"))).alias("approved"), F.max(F.when(F.col("command") == "search", F.col("ms"))).alias("searched"),
    )
    passed = F.col("gate").isNotNull() & (F.col("approved") >= F.col("gate"))
    return r.agg(F.count("gate").alias("gated_repos"), F.sum("events").alias("gate_events"), F.count_if(passed).alias("approved_after"), F.count_if(passed & (F.col("searched") >= F.col("approved"))).alias("searched_after"))


def stale_refresh(e: DataFrame, window: int = MINUTES_15) -> DataFrame:
    """(seq, refresh): per stale search the first index of its repo within the window, by one sort per repo.

    The next index at or after a search is a running minimum from the end; no pairs are formed.
    """
    later = W.partitionBy("repo").orderBy(F.col("ms").desc()).rangeBetween(W.unboundedPreceding, 0)
    nxt = F.min(F.when(F.col("command") == "index", F.col("ms"))).over(later)
    s = e.withColumn("next_index", nxt).filter((F.col("command") == "search") & F.coalesce("stale", F.lit(False)))
    return s.select("repo", "seq", "ms", F.when(F.col("next_index") <= F.col("ms") + window, F.col("next_index")).alias("refresh"))


def stale_summary(e: DataFrame, window: int = MINUTES_15) -> DataFrame:
    r = stale_refresh(e, window)
    searches = e.filter("command = 'search'").select("repo", F.col("ms").alias("s"))
    # The refresh's bucket and the next one hold every search that can follow in time.
    b = r.filter("refresh is not null").select("repo", "seq", "refresh", F.explode(F.array(F.floor(F.col("refresh") / window), F.floor(F.col("refresh") / window) + 1)).alias("bucket"))
    again = b.join(searches.withColumn("bucket", F.floor(F.col("s") / window)), ["repo", "bucket"]).filter((F.col("s") > F.col("refresh")) & (F.col("s") <= F.col("refresh") + window)).select("repo", "seq").distinct()
    j = r.join(again.withColumn("again", F.lit(True)), ["repo", "seq"], "left")
    return j.agg(F.count(F.lit(1)).alias("stale_searches"), F.count("refresh").alias("refreshed"), F.count("again").alias("searched_again"))


def context_joins(e: DataFrame, window: int = MINUTES_15) -> DataFrame:
    """(seq, search_seq, place): per context call on a path the nearest earlier search in the window, its agent's first.

    place is the path's position among that search's results, 0 if it is not there, null without a search.
    """
    c = e.filter("command = 'context' and target_form = 'path' and resolved_path is not null").select("repo", "seq", "ms", "resolved_path", F.col("agent.ppid_chain").alias("chain"))
    s = e.filter("command = 'search' and results is not null").select("repo", F.col("seq").alias("s_seq"), F.col("ms").alias("s_ms"), F.col("agent.ppid_chain").alias("s_chain"), F.transform("results", lambda r: r["path"]).alias("found"))
    b = c.withColumn("bucket", F.explode(F.array(F.floor(F.col("ms") / window), F.floor(F.col("ms") / window) - 1)))
    j = b.join(s.withColumn("bucket", F.floor(F.col("s_ms") / window)), ["repo", "bucket"]).filter((F.col("s_ms") <= F.col("ms")) & (F.col("s_ms") >= F.col("ms") - window))
    own = F.coalesce(F.col("chain") == F.col("s_chain"), F.lit(False))
    near = j.withColumn("n", F.row_number().over(W.partitionBy("repo", "seq").orderBy(own.desc(), F.desc("s_ms"), F.desc("s_seq")))).filter("n = 1")
    hit = near.select("repo", "seq", "s_seq", F.array_position("found", F.col("resolved_path")).cast("int").alias("place"))
    return c.select("repo", "seq").join(hit, ["repo", "seq"], "left")


def context_summary(joins: DataFrame) -> DataFrame:
    hit = F.col("place") > 0
    return joins.agg(
        F.count(F.lit(1)).alias("path_contexts"), F.count_if(hit).alias("joined"), F.count_if(F.col("place") == 0).alias("recovered"), F.count_if(F.col("place").isNull()).alias("unjoinable"),
        F.count_if(F.col("place") == 1).alias("top_hits"), round_up(F.avg(F.when(hit, F.col("place"))), 2).alias("mean_rank"),
    )
