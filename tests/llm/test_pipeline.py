"""The pipeline's stages against brute force, each on its own input."""

import random

import corpus_pipeline as C
from tests.llm import brute
from tests.llm.test_operators import ROWS


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in ROWS]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{sf}/documents.parquet")
    docs, now = spark.read.parquet(f"{sf}/documents.parquet"), ROWS
    for name, stage in C.STAGES:
        df = stage(spark, docs, sf)
        if name != "packing":
            assert df.columns == C.COLUMNS
        df.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        out = docs.collect()
        if name == "packing":
            brute.check_packing(now, [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")) for r in out])
            break
        new = sorted((r.doc_id, r.text) for r in out)
        assert all(r.n_chars == len(r.text) for r in out if r.text is not None and name != "quality_rules")
        if name == "quality_rules":
            assert set(new) <= set(now) and not {k for k, *_, failed in brute.base(ROWS) if failed} & {k for k, _ in new}
        elif name == "line_dedup":
            assert {k: brute.sha(t or "") for k, t in new} == {k: h for k, _, _, h in brute.lines(now)}
        elif name == "near_dedup":
            assert [k for k, _ in new] == [k for k, _, _, kept in brute.near(now) if kept]
        else:
            want = {k: h for k, _, _, _, h in brute.suffix(now)}
            assert all(brute.sha(t or "") == want[k] for k, t in new if (t or "").isascii())
        now = new
    assert C.run(spark, sf).count() == len(out)


def test_null_and_shared_ids(spark):
    """Rows without an id, or with one id and different texts, are documents of their own."""
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) + r.choice(["", " of the", " it"]) for _ in range(120)) + "."
    good, junk = [prose() for _ in range(8)], "spam " * 300
    near = good[6] + " more"
    rows = [(None, good[0]), (None, good[1]), (None, junk), (None, good[0]), (5, good[2]), (5, good[3]), (5, junk), (6, good[4]), (7, good[4]), (8, good[5]), (9, good[6]), (9, good[7]), (9, near), (10, None)]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t in rows for s in "ab"], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    pairs = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=key)
    assert pairs(C.quality_rules(spark, docs, "")) == sorted(((k, t) for k, t in rows if t not in (junk, None) for _ in "ab"), key=key)
    out = pairs(C.near_dedup(spark, docs, ""))
    assert len(out) == len(set(out))
    assert {t for _, t in out} - {good[6], near} == {t for _, t in rows} - {good[6], near}
    assert len({(9, good[6]), (9, near)} & set(out)) == 1
    assert (6, good[4]) in out and (7, good[4]) not in out and sum(t == junk for _, t in out) == 1
    alone = docs.filter("doc_id in (6, 7, 8)")
    assert pairs(C.near_dedup(spark, alone, "")) == [(6, good[4]), (8, good[5])]


def test_an_empty_table_and_other_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _k string, keep int").write.parquet(f"{sf}/documents.parquet")
    assert C.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert C.quality_rules(spark, docs, sf).columns == C.COLUMNS


def test_texts_are_not_sorted(spark):
    """Verdicts and classes meet the texts as hashed tables of ids; only rows repeated in full are aggregated."""
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(3, 7) for _ in range(120)) for _ in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, t, "en", "b", len(t)) for k, t in enumerate(texts)] + [(9, texts[1], "en", "b", len(texts[1]))]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame(rows, schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        how = plan(C.quality_rules(spark, docs, ""))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in how and "Sort" not in how
    out = C.near_dedup(spark, docs, "")
    assert "ShuffledHashJoin" in plan(out) and "Sort" not in plan(out)
    assert sorted(map(tuple, out.collect())) == rows[:5]
    # Some rows repeated in full: the least of each stays, next to those that come once.
    again = [(2, texts[2], "en", "a", len(texts[2])), (2, texts[2], "de", "c", len(texts[2])), rows[3]]
    want = sorted([*rows[:2], again[1], *rows[3:5]])
    for order in (rows + again, again[::-1] + rows):
        assert sorted(map(tuple, C.near_dedup(spark, spark.createDataFrame(order, schema).repartition(3), "").collect())) == want
