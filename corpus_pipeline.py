"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with ``n_chars`` counted anew where texts change; columns that
documents don't have in its description are left out.

A document is a row with its id and text. Rows without an id, and rows that share an id and have different texts, are documents
of their own; rows repeated in full are one document, of which ``near_dedup`` leaves one. Documents whose lines all stood
in earlier ones are empty after ``line_dedup``: they stay, as they link with nothing, and give one end token to the last stage.
Null texts fail the quality rules. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import linededup, minhash, packing, quality, suffixdedup
from quarryline.llm.common import id_in, materialize, tidy
from quarryline.llm.queries import tokenizer
from quarryline.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _k and _t, the id (a null id is an id of its own) and a hash of the text: together they name a document."""
    return docs.withColumn("_k", id_in("doc_id")).withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the weak-supervision verdict reject go."""
    ship(spark)
    keyed = _keyed(docs)
    kept = quality.judge(keyed, others=["_k", "_t"]).filter("kept").select("_k", "_t").distinct()
    # The hashed side has no texts; a merge join would sort them.
    return keyed.join(kept.hint("shuffle_hash"), ["_k", "_t"], "left_semi").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    ship(spark)
    return _counted(linededup.dedup(docs))


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; rows repeated in full are one document."""
    ship(spark)
    keyed = _keyed(docs)
    names = materialize(keyed.groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("_c")), "names")
    if names.groupBy("_k").count().filter("count > 1").take(1):
        # Rows of one id and different texts are nodes of their own: numbers in the order of (id, hash) stand for them.
        names = materialize(names.orderBy("_k", "_t").withColumn("_n", F.monotonically_increasing_id()), "numbers")
        keyed, node = materialize(keyed.join(names.drop("_c"), ["_k", "_t"]), "numbered"), "_n"
    else:
        node = "_k"
    # A null id is the smallest, as a null node is.
    kept = minhash.near_components(keyed, "doc_id" if node == "_k" else node).filter("kept").select(id_in("doc_id").alias(node)).distinct()
    # The hashed sides have no texts: those of rows that come once are neither sorted nor aggregated.
    if not names.filter("_c > 1").take(1):
        return keyed.join(kept.hint("shuffle_hash"), node, "left_semi").select(*COLUMNS)
    kept = materialize(kept.join(names.select(node, "_c"), node), "kept")
    once, again = (keyed.join(kept.filter(f"_c {x} 1").hint("shuffle_hash"), node, "left_semi") for x in ("=", ">"))
    # Of rows repeated in full one stays, whatever the order they come in.
    others = [c for c in COLUMNS if c != "text"]
    one = again.groupBy("_k", "_t").agg(F.min(F.struct(*others, "text")).alias("one"))
    return once.select(*COLUMNS).unionByName(one.select(*[F.col(f"one.{c}") for c in COLUMNS]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start earlier elsewhere go."""
    ship(spark)
    return _counted(suffixdedup.dedup(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024."""
    ship(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), 1024, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packed),
]
#: MinHash, suffix arrays and packing have no SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
