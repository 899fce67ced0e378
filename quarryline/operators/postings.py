"""Positional inverted index, as it is stored; ``matching`` reads it, or texts themselves, with many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarryline.functions.text import tokens


def index(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, col, term, positions, tf): a row per document, column and term."""
    one = [df.select(F.col(doc).alias("doc"), F.lit(c).alias("col"), F.posexplode(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias("pos", "term")) for c in columns]
    rows = one[0]
    for o in one[1:]:
        rows = rows.unionByName(o)
    return rows.groupBy("doc", "col", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count(F.lit(1)).alias("tf"))


def stats(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, len): tokens of all indexed columns."""
    n = sum((F.size(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns), F.lit(0))
    return df.select(F.col(doc).alias("doc"), n.cast("long").alias("len"))


def top(hits: DataFrame, k: int, by: str = "bm25") -> DataFrame:
    """The best ``k`` documents of each query; ties (to six digits) go to the smaller document."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round(by, 6)), "doc"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def terms_of(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(query_id, prefix, term): the terms that start with a prefix. terms: (term), each once; prefixes: (query_id, prefix).

    Terms of a dictionary, not of documents, meet the prefixes, by an equi-join on the first characters, as many as
    the prefix has but four at most, then the rest is compared.
    """
    heads = F.explode(F.transform(F.sequence(F.lit(2), F.least(F.greatest(F.length("term"), F.lit(2)), F.lit(4))), lambda n: F.substring("term", F.lit(1), n)))
    t = terms.filter("length(term) > 1").select("term", heads.alias("head"))
    q = prefixes.filter("length(prefix) > 1").select("query_id", "prefix", F.substring("prefix", 1, 4).alias("head"))
    return t.join(q, "head").filter(F.startswith("term", "prefix")).select("query_id", "prefix", "term").distinct()
