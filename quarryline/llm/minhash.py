"""Near-duplicate documents by one-permutation hashing with optimal densification.

1. Each task hashes its texts' word shingles (64 bit, distinct) and makes a signature: the hash range is cut into
   ``BINS`` bins, each holding its least hash; an empty bin takes the value of a bin that a universal hash of
   (bin, attempt) picks, trying until one is filled. Bands of ``ROWS`` bins give bucket keys. At a similarity of 0.85
   a pair misses all ``BINS / ROWS`` buckets with probability below 1e-6.
2. Rows with equal sets form a class, which has a number and the text of a row of its smallest doc_id; only classes go
   on, so that thousands of copies are one row. Sets of fewer than six shingles match equal sets alone at 0.85.
3. Buckets turn into stars: the member with the most bucket mates is the hub and is paired with the others, so
   that pairs grow with members, not with their square. Members that stars connect are a family. A pair is confirmed
   on full sets: texts of a family's members stream past the sets of its hubs, spread over many tasks.
4. Links join components. In buckets whose members still lie in several components, further members become hubs
   (eight times as many each round, ``MOST_HUBS`` at most) until each pair of members was compared or is connected:
   stars lose no link. Pairs grow with members unless a bucket keeps falling into pieces; how many rounds it
   takes then is the price of losing none.

Texts: A-Z lower-cased, words of characters other than blank and U+0009-U+000D. Null or wordless texts have an empty
set and link with nothing: each such row is a component of its own. Other rows that share an id are one node, whatever
their texts: each of the texts links, and what they reach is one component. Repeated rows repeat; a null id is an id of
its own (the smallest). An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarryline.llm.common import id_in, id_out, materialize, split_hot_join, tidy
from quarryline.llm.components import components, least_ids, shared_ids

WIDTH, THRESHOLD = 5, 85
BINS, ROWS = 252, 7
#: Hubs whose sets a task holds at once.
HUBS = 64
#: Hubs of a bucket in a round at most: an array of so many travels with its members.
MOST_HUBS = 512
BLOCK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _pow = np.full(n, _BASE, np.uint64)
            _inv = np.full(n, _U(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            _pow[0] = _inv[0] = 1
            _pow, _inv = np.cumprod(_pow, dtype=np.uint64), np.cumprod(_inv, dtype=np.uint64)
    return _pow, _inv


def prefix_hash(x: np.ndarray) -> np.ndarray:
    p, _ = powers(len(x) + 1)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + _U(1)) * p[: len(x)], out=out[1:])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per word of lower-cased text, in blocks that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut <= at:  # one long word, or other white space: go on to the next blank or line feed
                found = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
                cut = min(found) if found else len(data) - 1
            end = cut + 1
        x = np.frombuffer(data, np.uint8, end - at, at)
        word = ~((x == 32) | ((x >= 9) & (x <= 13)))
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p = prefix_hash(x)
        _, inv = powers(len(x) + 1)
        parts.append(mix((p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle."""
    w = word_hashes(text.encode().lower()) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    if len(w) < width:
        return mix(np.array([sum(int(h) * int(m) for h, m in zip(w, _MULT)) + len(w) & (1 << 64) - 1], np.uint64))
    n = len(w) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s += w[i : i + n] * _MULT[i % 5] * _U(2 * (i // 5) + 1)
    return np.unique(mix(s))


_donors = np.random.default_rng(20240501).integers(0, BINS, (4096, BINS))


def signature(s: np.ndarray) -> np.ndarray:
    """Least hash per bin, empty bins filled from bins that (bin, attempt) picks."""
    bins = ((s >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    filled = np.zeros(BINS, bool)
    sig = np.zeros(BINS, np.uint64)
    at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    sig[bins[at]] = s[at]
    filled[bins[at]] = True
    todo, a = np.flatnonzero(~filled), 0
    while len(todo):
        picks = _donors[a % 4096 : a % 4096 + 64, todo] if a < 4096 else np.broadcast_to(bins[at[:1]], (1, len(todo)))
        ok = filled[picks]
        got = ok.any(0)
        sig[todo[got]] = sig[picks[ok.argmax(0)[got], np.flatnonzero(got)]]
        todo, a = todo[~got], a + 64
    return sig


_band_mult = (np.random.default_rng(7).integers(0, 1 << 63, ROWS, dtype=np.uint64) << _U(1)) | _U(1)


def bands(sig: np.ndarray) -> np.ndarray:
    b = sig.reshape(-1, ROWS)
    return mix((b * _band_mult).sum(1, dtype=np.uint64) + np.arange(len(b), dtype=np.uint64) * _BASE)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k", "t", "n", "f1", "f2", "bands"]
    for b in batches:
        n, f1, f2, keys, ends = [], [], [], [], [0]
        for text in b.column(2):
            s = shingle_set(text.as_py())
            n.append(len(s))
            f1.append(s.sum(dtype=np.uint64))
            f2.append(mix(s * _BASE).sum(dtype=np.uint64))
            if len(s) >= 6:
                keys.append(bands(signature(s)))
            ends.append(ends[-1] + (BINS // ROWS if len(s) >= 6 else 0))
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names)


def _confirm(threshold: int) -> object:
    """Rows of one part of a family, its hubs first: the links that hold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            ids, a, c = b.column(3).to_pylist(), [], []
            for i, text in enumerate(b.column(5)):
                if keys[i] != now:
                    now, sets = keys[i], {}
                s, hubs = shingle_set(text.as_py()), b.column(4)[i]
                if not hubs.is_valid:
                    sets[ids[i]] = s
                    continue
                for h in hubs.values.to_numpy().tolist():
                    own = sets[h]
                    at = np.searchsorted(own, s)
                    common = int((own[np.minimum(at, len(own) - 1)] == s).sum()) if len(own) else 0
                    if 100 * common >= threshold * (len(s) + len(own) - common):
                        a.append(h)
                        c.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def links(docs: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (h, c, family) whose sets are similar enough. docs: (c, text).

    A family's hubs are dealt into parts of about ``HUBS`` and its members into parts by hash: a member's text
    travels once per part of hubs, a hub's once per part of members, not once per pair.
    """
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = pairs.groupBy("family").agg(F.approx_count_distinct("h").alias("hubs"), F.count(F.lit(1)).alias("n"))
    size = materialize(size.select("family", "n", F.ceil(F.col("hubs") / HUBS).alias("chunks"), F.least(F.ceil(F.col("n") / 512), F.lit(most)).alias("salts")), "families")
    p = split_hot_join(pairs, size, ["family"], "n")
    p = p.select("family", F.pmod(F.xxhash64("h"), "chunks").alias("chunk"), F.pmod(F.xxhash64("c"), "salts").alias("salt"), "h", "c")
    key = ["family", "chunk", "salt"]
    p = materialize(p, "parts")
    members = p.groupBy(*key, "c").agg(F.collect_list("h").alias("hubs")).join(docs, "c").select(*key, F.col("c").alias("id"), "hubs", "text")
    hubs = p.select(*key, F.col("h").alias("c")).distinct().join(docs, "c").select(*key, F.col("c").alias("id"), F.lit(None).cast("array<long>").alias("hubs"), "text")
    both = members.unionByName(hubs).repartition(*key).sortWithinPartitions(*key, F.col("hubs").isNotNull())
    return both.mapInArrow(_confirm(threshold), "a long, b long")


@tidy
def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(id_in(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    sigs = materialize(source.mapInArrow(_signatures, "k long, t long, n long, f1 long, f2 long, bands array<long>"), "signatures")
    key = ["n", "f1", "f2"]
    classes = sigs.filter("n > 0").groupBy(*key).agg(F.min("k").alias("least"), F.min_by("t", "k").alias("t"), F.count(F.lit(1)).alias("copies"))
    # A class is a node under a number that the written table fixes, not under an id, which other classes may share.
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    of = materialize(split_hot_join(sigs.select("k", *key), classes.drop("t"), key, "copies").select("k", "n", "c", "least"), "class-of")
    # A class goes on as a row of its smallest id and that row's text: equal texts have equal sets.
    # Merge joins where a side grows with the corpus: small corpora then take the same plan as large ones.
    named = classes.select("c", F.col("least").alias("k"), "t")
    reps = sigs.filter("size(bands) > 0").join(named.hint("merge"), ["k", "t"]).select("c", "n", "bands").dropDuplicates(["c"])
    reps = materialize(reps, "representatives")
    buckets = reps.select("c", F.explode("bands").alias("b"))
    sizes = materialize(buckets.groupBy("b").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket-sizes")
    members = materialize(_with_sizes(buckets, sizes), "members")
    degree = members.groupBy("c").agg(F.sum("size").alias("degree")).join(reps.select("c", "n"), "c")
    members = materialize(members.join(degree, "c").select("b", "c", "n", "degree"), "members")
    top = members.groupBy("b").agg(F.max(F.struct("degree", F.bitwise_not("c").alias("not_c"))).alias("x"), F.count(F.lit(1)).alias("size")).select("b", "size", F.bitwise_not("x.not_c").alias("hub"))
    star = split_hot_join(members, materialize(top, "hubs"), ["b"], "size").filter("c <> hub").select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct()
    family = materialize(components(star), "families").withColumnRenamed("node", "c").withColumnRenamed("component", "family")
    members = materialize(members.join(family, "c", "left").withColumn("family", F.coalesce("family", "c")), "members")
    asked = members.select("c").distinct().join(named.hint("merge"), "c")
    texts = materialize(source.join(asked.hint("merge"), ["k", "t"]).select("c", "text"), "candidate-texts")
    if texts.groupBy("c").count().filter("count > 1").take(1):  # rows repeated in full
        texts = materialize(texts.dropDuplicates(["c"]), "candidate-texts")
    found, tested, hubs = shared_ids(of), None, 1
    parts = None if found is None else materialize(components(found), "components")
    while True:
        pairs, members = _stars(members, hubs, threshold)
        if tested is not None:
            pairs = pairs.join(tested, ["h", "c"], "left_anti")  # pairs of one bucket that another one had before
        pairs = materialize(pairs, "pairs")
        any_pair = bool(pairs.take(1))
        if not any_pair and not members.take(1):
            break
        hubs = min(8 * hubs, MOST_HUBS)
        if not any_pair:
            continue
        new = materialize(links(texts, pairs, threshold), "links")
        found = new if found is None else found.unionByName(new)
        tested = pairs.select("h", "c") if tested is None else tested.unionByName(pairs.select("h", "c"))
        parts = materialize(components(found), "components")
        members = materialize(_unsettled(members, parts), "members")
        if not members.take(1):
            break
    comp = F.coalesce("least", "k")
    if parts is not None:
        of = of.join(least_ids(parts, classes), "c", "left")
        comp = F.coalesce("reached", comp)
    of = of.withColumn("comp", comp)
    return of.select(id_out("k").alias("doc_id"), F.col("n").alias("n_shingles"), id_out("comp").alias("component_id"), (F.col("k") == F.col("comp")).alias("kept"))


def _with_sizes(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of buckets that have mates."""
    return split_hot_join(buckets, sizes, ["b"], "size").filter("size is not null")


def _stars(members: DataFrame, hubs: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's ``hubs`` members of highest degree with the members behind them; the members left.

    The rank limit reaches below the shuffle (a task hands on ``hubs`` rows of a bucket), so no bucket is sorted whole.
    """
    extra = [c for c in members.columns if c == "component"]
    rank = F.row_number().over(W.partitionBy("b").orderBy(F.desc("degree"), "c"))
    top = members.withColumn("rank", rank).filter(F.col("rank") <= hubs)
    heads = top.groupBy("b").agg(F.collect_list(F.struct("c", "n", "degree", *extra)).alias("heads"))
    sized = materialize(members.groupBy("b").agg(F.count(F.lit(1)).alias("size")).join(heads, "b"), "heads")
    j = split_hot_join(members, sized, ["b"], "size")
    pairs = j.select("c", "n", "degree", "family", *extra, F.explode("heads").alias("x"))
    # Degree, then id, orders all members everywhere: a pair met in several buckets has one hub.
    pairs = pairs.filter("x.degree > degree or (x.degree = degree and x.c < c)")
    pairs = pairs.filter(100 * F.least("n", "x.n") >= threshold * F.greatest("n", "x.n"))
    if extra:
        pairs = pairs.filter("x.component <> component")
    left = j.filter(~F.exists("heads", lambda x: x["c"] == F.col("c"))).select(*members.columns)
    return pairs.select(F.col("x.c").alias("h"), "c", "family").distinct(), left


def _unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with their components, of buckets that hold more than one component."""
    base = members.drop("component").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    base = materialize(base, "members")
    open_ = materialize(base.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi"), "open")
    return split_hot_join(base, open_, ["b"], "size").filter("size is not null").select(*members.drop("component").columns, "component")
