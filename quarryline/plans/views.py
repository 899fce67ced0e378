"""Views over the driver's tables that give every operator an input: files, an import graph, a usage log, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import paths

#: doc_id modulo 20 to the path of a file; the SQL of the checks uses the same expressions.
TEMPLATES = [
    "'src/' || 'g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 9 AS VARCHAR(9)) || '/mod_' || doc_id || '.ts'", "'src/' || 'g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 9 AS VARCHAR(9)) || '/mod_' || (doc_id - 1) || '.test.ts'", "'docs/' || lang || '/note_' || doc_id || '.md'",
    "'docs/adr/' || doc_id || '-' || lang || '.md'", "'scripts/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN doc_id || '/setup.py' ELSE 'task_' || doc_id || '.py' END", "'packages/' || source || '/src/part_' || doc_id || '.js'",
    "'config/' || source || '.' || doc_id || '.json'", "'vendor/lib_' || doc_id || '/package-lock.json'", "'apps/' || source || '_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/AGENTS.md' ELSE '/README.md' END",
    "'packages/' || source || '/pkg_' || doc_id || '/package.json'", "'src/providers/' || source || '/provider_' || doc_id || '.py'", "'web_' || doc_id || '/app/api/items/' || lang || '/route.ts'",
    "'src/' || source || '/' || doc_id || '/index.ts'", "'tests/' || source || '/mod_' || (doc_id - 13) || '.test.ts'", "'dist/' || source || '/bundle_' || doc_id || '.min.js'",
    "'docs/archive/' || doc_id || '.md'", "'native/' || 'g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 9 AS VARCHAR(9)) || '/unit_' || doc_id || '.c'", "'native/' || 'g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 9 AS VARCHAR(9)) || '/unit_' || (doc_id - 1) || '.h'",
    "'src/items_' || lang || '_handler_' || doc_id || '.ts'", "'assets/' || source || '/pic_' || doc_id || '.png'",
]
PATH = "CASE doc_id % 20 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES)) + " END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    d = table(spark, sf, "documents")
    cols = [F.col("doc_id").alias("file_id"), F.expr(PATH).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), "source", "lang", *(["text"] if text else [])]
    return d.select(*cols).withColumn("language", paths.language(F.col("path")))


def repo_sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, language, text): a module per supplier that imports the modules of the parts it ships."""
    # One shuffle by supplier serves both; keys travel and meet, not lines.
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey").distinct()
    line = lambda k: F.concat(F.lit("import { P"), k, F.lit(" } from '../parts/part_"), k, F.lit("';"))
    s = li.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.transform(F.collect_list("l_partkey"), line)), "\n").alias("text"))
    p = table(spark, sf, "part").select(F.concat(F.lit("src/parts/part_"), "p_partkey", F.lit(".ts")).alias("path"), F.format_string("export class P%d {\n  size = %d;\n}", "p_partkey", "p_size").alias("text"))
    out = s.select(F.concat(F.lit("src/suppliers/supplier_"), "l_suppkey", F.lit(".ts")).alias("path"), "text").unionByName(p)
    return out.select("path", F.lit("typescript").alias("language"), "text")


def repo_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The same graph without parsing. Pairs are told apart behind the shuffle by supplier: before it hardly any is equal, and all would be held."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey").distinct()
    return li.select(
        F.concat(F.lit("src/suppliers/supplier_"), "l_suppkey", F.lit(".ts")).alias("src"), F.concat(F.lit("src/parts/part_"), "l_partkey", F.lit(".ts")).alias("dst"),
        F.lit("imports").alias("kind"), F.lit(None).cast("string").alias("specifier"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
    )


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    e = repo_edges(spark, sf)
    p = table(spark, sf, "part").select(F.concat(F.lit("src/parts/part_"), "p_partkey", F.lit(".ts")).alias("path"))
    return e.select(F.col("src").alias("path")).unionByName(p).distinct()


def cyclic_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A graph over all customers with orders: chains of twenty, some of which lead back to their start, and a hub that every chain may reach."""
    n, o = F.col("o_custkey"), F.col("o_orderkey")
    to = F.when(o % 31 == 0, F.lit(0)).when((o % 2 == 0) & (n % 7 == 3), n - n % 20).when(n % 20 == 19, n).otherwise(n + 1)
    e = table(spark, sf, "orders").select(F.concat(F.lit("n"), n).alias("src"), F.concat(F.lit("n"), to).alias("dst"))
    return e.distinct().withColumn("kind", F.lit("imports"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a usage log, with ``repo``, ``ms`` and ``seq``."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    view, click, signup = kind == "view", kind == "click", kind == "signup"
    k = F.col("k")
    when = lambda cond, x: F.when(cond, x)
    shown = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.concat(F.lit("f"), (k + i) % 10).alias("path")))
    return e.select(
        F.col("event_id").alias("seq"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.when(kind.isin("view", "error"), "search").when(click, "context").when(signup, "index").otherwise("status").alias("command"),
        when(k % 2 == 1, F.lit("cli")).alias("adapter"), when(k % 10 != 0, F.concat(F.lit("1."), k % 3)).alias("tool_version"), F.col("value").alias("latency_ms"),
        F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, "not_approved").otherwise("error")).when(view & (F.col("value") < 10), "empty").otherwise("ok").alias("outcome"),
        F.when(kind == "error", F.concat(F.lit("E"), k % 4)).alias("error_kind"), F.col("user_id").cast("string").alias("repo"),
        F.struct(F.concat(F.lit("c"), F.col("user_id") % 7 + k % 2).alias("ppid_chain"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("h"), F.col("user_id") % 3)).alias("harness")).alias("agent"),
        when(view, k.cast("double")).alias("top_score"), when(view, F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit("single")), k % 3 + 1)).alias("top_hit_confidence"),
        when(view, k % 3 == 0).alias("stale"), when(view, k % 5 == 0).alias("cap_hit"), when(view, shown).alias("results"),
        when(click, F.when(k % 4 == 0, "query").otherwise("path")).alias("target_form"), when(click, F.concat(F.lit("f"), k % 10)).alias("resolved_path"),
        when(signup, k % 2 == 0).alias("approve"), when(signup, F.col("value") * 2).alias("duration_ms"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the passages of the benchmark table."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
