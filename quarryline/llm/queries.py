"""The registered queries of this subpackage, with the parameters they would run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import read
from quarryline.session import ship


def tokenizer(name: str) -> str:
    """Where a vocabulary file is; its place is a setting of the installation, not of this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import encoding

    docs, path = read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json")
    return encoding.digests(docs, path, encoding.build_lexicon(docs, path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import warc

    return warc.index(spark, warc.write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import packing

    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), 1024, 0)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import minhash

    return minhash.near_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import embeddings

    return embeddings.near_components(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import suffixdedup

    return suffixdedup.digests(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import toxicity

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import sstable

    _, manifest = sstable.write_shards(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"), 1)
    return sstable.read_shards(spark, manifest)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import quality

    out = quality.judge(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_quality", 6).alias("p_quality"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.llm import linededup

    return linededup.digests(read(spark, sf_dir, "documents", "doc_id", "text"))


def _shipping(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipping(f) for name, f in list(globals().items()) if name.startswith("op") and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op2_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), r AS (SELECT h, max(page_id) AS ref FROM p GROUP BY 1)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN ref = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN ref <> page_id THEN ref END AS refers_to FROM p JOIN r ON p.h = r.h""",
    "op5_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
 m AS (SELECT x, min(y) AS component_id FROM c GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
 SELECT m.x AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, m.x = component_id AS kept FROM m LEFT JOIN n ON m.x = n.x""",
    "op10_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
 k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM l), f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
 FROM k LEFT JOIN f ON k.key = f.key GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
