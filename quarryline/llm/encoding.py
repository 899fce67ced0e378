"""Encoding and decoding of whole texts with a lexicon of the corpus's frequent pieces.

``build_lexicon`` counts pieces over all documents (partial counts per task, so one hot piece is one row per
task), keeps those that are at least one in ``size`` of all and compiles them with their ids into a minimal acyclic transducer
in the shared folder, which the tasks map into memory. The size bounds memory alone: a piece that the lexicon
lacks is merged exactly, with the same ids.

Null and empty texts have no ids; a special token's text inside a document is that token; rows are independent,
so repeated rows and ids repeat; an empty table gives an empty lexicon and no rows; other columns are not read by the
digests and kept by ``encode`` and ``decode``, whose new column gets a name that the table doesn't have yet.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.bpe import PIECES_AT_ONCE, Codec, Lexicon, codec
from quarryline.llm.common import drop_written, free_name, materialize, new_dir, posix

LEXICON_PIECES = 1 << 17
#: A task hands on its counts when it holds so many different pieces.
COUNTED_AT_ONCE = 200_000


def build_lexicon(df: DataFrame, tokenizer: str, text_col: str = "text", size: int = LEXICON_PIECES) -> str:
    """The path of a lexicon of the most frequent pieces of all texts."""
    spark = df.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, found = codec(tokenizer), Counter()

        def give() -> Iterator[pa.RecordBatch]:
            # All pieces go on, also those a task saw once: they may add up. The null piece counts all of them.
            keys = [*found, None]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*found.values(), found.total()], pa.int64())], ["piece", "n"])
            found.clear()

        def add(pieces: list[str]) -> None:
            d = pa.array(pieces, pa.string()).dictionary_encode()
            for p, n in zip(d.dictionary.to_pylist(), np.bincount(d.indices.to_numpy()).tolist()):
                found[p] += n

        for b in batches:
            pieces = []
            for text in b.column(0):
                if t := text.as_py():
                    pieces += code.parts(t)
                if len(pieces) >= PIECES_AT_ONCE:
                    add(pieces)
                    pieces = []
            add(pieces)
            if len(found) > COUNTED_AT_ONCE:
                yield from give()
        if found:
            yield from give()

    counted = (
        df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).filter("piece is null or (n >= 4 and length(piece) <= 64)")
    )
    counted = materialize(counted, "pieces")
    total = counted.filter("piece is null").agg(F.max("n")).first()[0] or 0
    # Fewer than ``size`` pieces can each be a ``size``-th of all: no sort, and a bound on what the driver takes.
    top = counted.filter("piece is not null").filter(F.col("n") * size >= total)
    plain = Codec(tokenizer)
    words = [(r.piece.encode(), np.frombuffer(plain.merge(r.piece), "<u4").tolist()) for r in top.collect()]  # at most ``size`` rows
    drop_written(counted)
    folder = posix(new_dir(spark, "lexicon"))
    os.makedirs(folder, exist_ok=True)
    Lexicon.build(f"{folder}/lexicon.bin", words)
    return f"{folder}/lexicon.bin"


def encode(df: DataFrame, tokenizer: str, lexicon: str | None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids as an array of integers (null texts have none)."""
    names, out_col = df.columns, free_name(out_col, df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at = codec(tokenizer, lexicon), names.index(text_col)
        for b in batches:
            parts = list(code.encode_many(t.as_py() for t in b.column(at)))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<u4"), *parts]).view("<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of the ids (of null: empty)."""
    names, out_col = df.columns, free_name(out_col, df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at = codec(tokenizer), names.index(ids_col)
        for b in batches:
            texts = [code.decode(x.values.to_pylist() if x.is_valid else []) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def digests(df: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass without handing ids on: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer, lexicon)
        table = code.byte_table()
        decimal = [str(i) for i in range(len(table))]
        for b in batches:
            n, shown, back = [], [], []
            for found in code.encode_many(t.as_py() for t in b.column(1)):
                ids = found.tolist()
                n.append(len(ids))
                shown.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip((n, shown, back), fields[1:]))], [f for f, _ in fields])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
