"""Snapshots, telemetry, usage logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import usage
from quarryline.plans.store import Store, telemetry
from quarryline.streaming import ingest
from quarryline.streaming import usage as stream


def test_snapshots_move_as_one(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("t") is None
    s.commit({"t": spark.range(2)})
    with pytest.raises(Exception):  # noqa: B017
        s.commit({"t": spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))})
    assert s.current() == 1 and s.read("t").count() == 2
    s.commit({"t": spark.range(3)})
    assert s.read("t").count() == 3 and s.read("t", 1).count() == 2


def test_telemetry_never_changes_a_result(tmp_path):
    log = str(tmp_path / "u.jsonl")
    with telemetry(log, "search", query="x"):
        pass
    with pytest.raises(KeyError):
        with telemetry(log, "index"):
            raise KeyError("k")
    with telemetry("/nowhere/at/all", "status"):
        pass
    rows = [json.loads(x) for x in open(log)]
    assert [(r["command"], r["outcome"], r.get("error_kind")) for r in rows] == [("search", "ok", None), ("index", "error", "KeyError")]


LINES = [
    '{"ts":"2024-01-01T00:00:00.000Z","command":"search","repo_key":"r","results":[{"path":"a"},{"path":"b"}],"agent":{"ppid_chain":"c1","session":"s"}}',
    '{"ts":"2024-01-01T00:05:00.000Z","command":"context","repo_key":"r","target_form":"path","resolved_path":"b","agent":{"ppid_chain":"c1"}}', "{bad", "", '{"command":"x"}', "[1]",
    '{"ts":"2024-01-02T01:00:00.000Z","command":"context","repo_key":"r","target_form":"path","resolved_path":"a"}',
]


def test_usage_log(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text("\n".join(LINES))
    events, counts = usage.read(spark, [str(tmp_path / "u.jsonl")])
    assert tuple(counts.first()) == (6, 3) and events.count() == 3
    e = usage.prepare(events).withColumn("seq", F.col("ms"))
    assert sorted((r.place for r in usage.context_joins(e).collect()), key=str) == [2, None]
    assert usage.only(events, "r", "2024-01-02").count() == 1


def test_usage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/u.jsonl").write_text("\n".join(LINES))
    q = stream.daily(stream.events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.command, r.n) for r in spark.table("daily").orderBy("command").collect()] == [("context", 1), ("search", 1)]
    e = stream.events(spark, str(tmp_path / "in"))
    q = stream.followed(e, stream.events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.resolved_path for r in spark.table("followed").collect()] == ["b"]


def test_ingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i, rows in enumerate(([("a.md", "# A\nx"), ("b.bin", "?")], [("a.md", "# B"), ("c.py", "def f():\n  pass")])):
        spark.createDataFrame(rows, "path string, text string").write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"))
        q.awaitTermination()
        assert store.current() == i + 1
    assert sorted(r.path for r in store.read("files").collect()) == ["a.md", "c.py"]
    assert [r.chunk for r in store.read("chunks").filter("path = 'a.md'").collect()] == ["# B"]


def test_ingest_keeps_the_last_arrival(spark, tmp_path):
    schema = "path string, text string, arrived long"
    store = Store(spark, str(tmp_path / "s"))
    spark.createDataFrame([("a.md", "# old", 1), ("a.md", "# new", 3), ("a.md", "# middle", 2)], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert [r.chunk for r in store.read("chunks").collect()] == ["# new"]
