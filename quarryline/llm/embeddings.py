"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact.

Unit vectors are turned into the principal axes of all vectors (one d x d sum per task and dimension d). A label's
vectors of one dimension are a tile if they fit (``TILE_BYTES``); else they are cut along the leading axis into slabs as
wide as two vectors of cosine t can lie apart (sqrt(2 - 2t)), a slab that is still too large along the next axis, and so
on (``LEVELS`` axes at most; what is too large then is cut by a hash). Vectors that link are in one cell or in neighbouring
ones, so only tiles of one label and of neighbouring cells meet. Before they do, their centres and radii tell of some pairs
that nothing in them links, and of others that everything does: a hot group of close vectors is counted, not compared.

Two tiles are compared in blocks of ``BLOCK`` rows in the order of the first axis. Blocks are skipped by their extent on
the leading axes and counted whole by their radii; else leading axes come first: the product so far plus the product
of the norms of what is left bounds the cosine, and pairs that cannot reach t drop out before the next axes. What is left is
checked on the original vectors in double precision.

Equal vectors of one label form a class that goes on as one row with a count. A tile pair gives, per row, the
number of vectors linked and a spanning forest of its links (as many edges as rows at most), never all pairs.
A tile travels once per tile it meets; a large cell is many tiles, spread over many tasks.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
nothing. Vectors of different dimension never link. A row reports the links of its own vector; for components, rows that
share an id (a null id is one, the smallest) are one node, but for rows that link with nothing. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import id_in, id_out, materialize, split_hot_join, tidy
from quarryline.llm.components import components, least_ids, shared_ids

THRESHOLD = 0.98
#: Bytes of a tile's vectors, though it may hold LEAST_ROWS; axes along which cells are cut; rows compared at once.
TILE_BYTES, LEAST_ROWS = 8 << 20, 1024
LEVELS = 8
BLOCK = 1024
STEPS = (8, 24)
EPS = 1e-9
#: A d x d sum goes to the driver for each dimension met; more than these many dimensions keep their own axes.
AXES_FOR, LARGEST_D = 4, 2048


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for d, x in _by_dim(b, 0):
            if d <= LARGEST_D:
                n, s = sums.get(d, (0, np.zeros((d, d))))
                sums[d] = n + len(x[1]), s + x[1].T @ x[1]
    for d, (n, s) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["d", "n", "s"])


def _by_dim(b: pa.RecordBatch, col: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows of the batch by dimension: their places, and unit vectors."""
    lists = b.column(col)
    size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # first, so that no square over- or underflows
        yield int(d), (rows, x / np.linalg.norm(x, axis=1, keepdims=True))


def _axes(reps: DataFrame) -> dict[int, np.ndarray]:
    top: dict[int, tuple[int, np.ndarray]] = {}
    # Tasks' sums meet on executors first: one row per dimension and group of tasks, each of d x d numbers.
    for r in reps.select("v").mapInArrow(_moments, "d int, n long, s array<double>").repartition(8, "d").mapInArrow(_add, "d int, n long, s array<double>").toLocalIterator():
        if r.d in top or len(top) < AXES_FOR:
            n, s = top.get(r.d, (0, 0.0))
            top[r.d] = n + r.n, s + np.array(r.s).reshape(r.d, r.d)
    return {d: np.linalg.eigh(s)[1][:, ::-1].copy() for d, (_, s) in top.items()}


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for i, d in enumerate(b.column(0).to_pylist()):
            n, s = sums.get(d, (0, 0.0))
            sums[d] = n + b.column(1)[i].as_py(), s + b.column(2)[i].values.to_numpy()
    for d, (n, s) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["d", "n", "s"])


def _cells(axes: dict[int, np.ndarray], width: float) -> object:
    """Rows with their dimension and the numbers of their slabs along the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            dim, g = np.zeros(n, np.int32), np.zeros((n, LEVELS), np.int32)
            for d, (rows, x) in _by_dim(b, 2):
                y = x @ axes[d][:, :LEVELS] if d in axes else x[:, :LEVELS]
                dim[rows] = d
                g[rows, : y.shape[1]] = np.floor(y / width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * LEVELS), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dim), lists], ["c", "label", "d", "g"])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    u = v / np.abs(v).max(1, keepdims=True)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, lists: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Groups of rows with equal first ``keys`` columns, which come sorted: the key, the columns behind it, and the vectors of column ``lists``."""
    held: list[list[np.ndarray]] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(i).to_numpy() for i in range(keys)]
        rest = [b.column(i).to_numpy() for i in range(keys, lists)]
        v = b.column(lists)
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(size)))
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            mine = tuple(int(k[start]) for k in key)
            if now is not None and now != mine:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = mine
            held.append([*(r[start:end] for r in rest), flat[ends[start] : ends[end]].reshape(end - start, -1)])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile: its centre and radius, the number of vectors it stands for, and its smallest class."""
    for (name,), (c, copies, v) in _grouped(batches, 1, 3):
        u = _unit(v)
        centre = u.mean(0)
        radius = float(np.linalg.norm(u - centre, axis=1).max())
        kinds = [("name", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("weight", pa.int64()), ("head", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((name, centre.tolist(), radius, int(copies.sum()), int(c.min())), kinds)], [n for n, _ in kinds])


def _pairs_in_tiles(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= t. a, b: unit vectors; ra, rb: the same in principal axes."""
    d = a.shape[1]
    steps = [s for s in STEPS if s < d] or [d]
    tail = lambda r, s: np.sqrt(np.maximum(0.0, 1.0 - (r[:, :s] ** 2).sum(1)))
    s = steps[0]
    bound = ra[:, :s] @ rb[:, :s].T
    bound += np.multiply.outer(tail(ra, s), tail(rb, s))
    i, j = np.nonzero(bound >= t - EPS)
    for s in steps[1:]:
        part = np.einsum("ij,ij->i", ra[i, :s], rb[j, :s]) + tail(ra, s)[i] * tail(rb, s)[j]
        ok = part >= t - EPS
        i, j = i[ok], j[ok]
    keep = [np.einsum("ij,ij->i", a[i[p : p + 65536]], b[j[p : p + 65536]]) >= t for p in range(0, len(i), 65536)]
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Enters the links i-j into the components that ``root`` names (in place); the links that joined two of them."""
    out = []
    while True:
        r, s = root[i], root[j]
        on = r != s
        if not on.any():
            return out
        i, j, r = i[on], j[on], r[on]
        first = np.unique(r, return_index=True)[1]  # a link per component: their number at least halves each time
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _blocks(rows: np.ndarray, turned: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Rows in the order of the first axis, BLOCK at once: places, least and greatest on leading axes, centre, radius."""
    rows = rows[np.argsort(turned[rows, 0], kind="stable")]
    out = []
    for p in range(0, len(rows), BLOCK):
        q = rows[p : p + BLOCK]
        x = turned[q]
        centre = x.mean(0)
        out.append((q, x[:, : STEPS[0]].min(0), x[:, : STEPS[0]].max(0), centre, np.linalg.norm(x - centre, axis=1).max()))
    return out


def linked(unit: np.ndarray, turned: np.ndarray, sides: tuple[np.ndarray, np.ndarray], copies: np.ndarray, t: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per row the number of vectors on the other side that it links with, and a spanning forest of the links.

    sides: the places of both tiles' rows; one array twice for a tile with itself.
    """
    reach2 = 2 - 2 * t
    n, edges, root = np.zeros(len(unit), np.int64), [], np.arange(len(unit))
    same = sides[0] is sides[1]
    A = _blocks(sides[0], turned)
    B = A if same else _blocks(sides[1], turned)
    for p, (i, lo, hi, centre, radius) in enumerate(A):
        for j, lo2, hi2, centre2, radius2 in B[p:] if same else B:
            own = i is j
            apart = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            if (apart**2).sum() > reach2 + EPS:
                continue
            between = np.linalg.norm(centre - centre2)
            if between - radius - radius2 > math.sqrt(reach2) + EPS:
                continue
            if between + radius + radius2 < math.sqrt(reach2) - EPS:
                n[i] += copies[j].sum() - (copies[i] if own else 0)
                if not own:
                    n[j] += copies[i].sum()
                every = i if own else np.concatenate((i, j))
                x, y = (every[1:], np.full(len(every) - 1, every[0])) if own else (np.concatenate((i, j)), np.concatenate((np.full(len(i), j[0]), np.full(len(j), i[0]))))
            else:
                x, y = _pairs_in_tiles(unit[i], unit[j], turned[i], turned[j], t)
                if own:
                    x, y = x[x < y], y[x < y]
                x, y = i[x], j[y]
                n += np.bincount(x, copies[y], len(n)).astype(np.int64) + np.bincount(y, copies[x], len(n)).astype(np.int64)
            edges += _join(root, x, y)
    return n, edges


def _compare(axes: dict[int, np.ndarray], t: float) -> object:
    """Rows of a tile pair, sorted by side: link counts per class (b is null), and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (one, two), (side, c, copies, v) in _grouped(batches, 2, 5):
            unit = _unit(v)
            turned = unit @ axes[v.shape[1]] if v.shape[1] in axes else unit
            every = np.arange(len(c))
            n, edges = linked(unit, turned, (every, every) if one == two else (np.flatnonzero(side == 0), np.flatnonzero(side == 1)), copies, t)
            at = np.flatnonzero(n)
            e = np.array(edges, np.int64).reshape(-1, 2)
            a = np.concatenate((c[at], c[e[:, 0]]))
            b = np.concatenate((np.zeros(len(at), np.int64), c[e[:, 1]]))
            links = np.concatenate((n[at], np.full(len(e), -1)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], ["a", "b", "links"])

    return run


def _tiles(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed: (c, label, d, g). (c, name) of all rows, and the tiles: name, label, d, level, cell (the slabs as far as its level), tile."""
    most = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(TILE_BYTES) / (8 * F.col("d"))))
    todo, parts = placed.select("c", "label", "d", "g"), []
    for level in range(LEVELS + 1):
        todo = todo.withColumn("cell", F.slice("g", 1, level))
        key = ["label", "d", "cell"]
        sizes = materialize(todo.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "cell-sizes").withColumn("tiles", F.ceil(F.col("n") / most).cast("int"))
        todo = materialize(split_hot_join(todo, sizes, key, "n").withColumn("level", F.lit(level)), "cells")
        if level == LEVELS:
            parts.append(todo)
            break
        parts.append(todo.filter("tiles = 1"))
        todo = todo.filter("tiles > 1").select("c", "label", "d", "g")
        if not todo.take(1):
            break
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    key = ["label", "d", "level", "cell", "tile"]
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("c"), "tiles")).select("c", *key)
    tiles = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.monotonically_increasing_id()), "tile-list")
    return materialize(split_hot_join(rows, tiles, key, "n").select("c", "name"), "tile-of"), tiles


def _meetings(tiles: DataFrame) -> DataFrame:
    """(x, y), x <= y: the tiles of one label and dimension whose cells are one or neighbours, as far as both are cut."""
    near = F.expr("aggregate(cell, array(cast(array() as array<int>)), (acc, s) -> flatten(transform(acc, p -> array(concat(p, array(s - 1)), concat(p, array(s)), concat(p, array(s + 1))))))")
    asks = tiles.select(F.col("name").alias("x"), "label", "d", "level", F.explode(near).alias("cell"))
    has = tiles.select(F.col("name").alias("y"), "label", "d", F.explode(F.transform(F.sequence(F.lit(0), "level"), lambda j: F.struct(j.alias("level"), F.slice("cell", F.lit(1), j).alias("cell")))).alias("s"))
    met = asks.join(has.select("y", "label", "d", "s.level", "s.cell"), ["label", "d", "level", "cell"])
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


@tidy
def near_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    v = F.col(vec_col).cast("array<double>")
    finite = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = df.select(id_in(id_col).alias("k"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.expr(f"label is not null and {finite}"), F.lit(False)))
    key = ["label", "f1", "f2"]
    bits = F.transform("v", lambda x: x + 0.0)  # -0.0 is 0.0
    rows = rows.withColumn("f1", F.xxhash64(bits)).withColumn("f2", F.xxhash64(F.lit(5), bits))
    classes = rows.filter("ok").groupBy(*key).agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("copies"))
    # A class is a node under a number that the written table fixes: other classes may have its ids.
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    of = materialize(split_hot_join(rows.filter("ok").select("k", *key), classes, key, "copies").select("k", "c", "least", "copies"), "vector-class-of")
    reps = rows.filter("ok").join(classes.withColumnRenamed("least", "k"), [*key, "k"]).dropDuplicates(["c"]).select("c", "label", "copies", "v")
    reps = materialize(reps, "vectors")
    axes = _axes(reps)
    placed = materialize(reps.select("c", "label", "v").mapInArrow(_cells(axes, width), "c long, label string, d int, g array<int>"), "vector-cells")
    name_of, tiles = _tiles(placed)
    tiled = materialize(reps.select("c", "copies", "v").join(name_of, "c").select("name", "c", "copies", "v"), "tiles")
    balls = tiled.repartition("name").sortWithinPartitions("name").mapInArrow(_balls, "name long, centre array<double>, radius double, weight long, head long")
    balls = materialize(balls, "tile-balls")
    side = lambda n: balls.select(*[F.col(c).alias(n if c == "name" else f"{n}_{c}") for c in balls.columns])
    apart = F.sqrt(F.expr("aggregate(zip_with(x_centre, y_centre, (a, b) -> (a - b) * (a - b)), 0.0D, (a, b) -> a + b)"))
    met = _meetings(tiles).join(side("x"), "x").join(side("y"), "y").withColumn("apart", apart)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    met = met.filter((F.col("x") == F.col("y")) | (F.col("apart") - F.col("x_radius") - F.col("y_radius") <= reach + EPS))
    whole = (F.col("x") != F.col("y")) & (F.col("apart") + F.col("x_radius") + F.col("y_radius") < reach - EPS)
    met = materialize(met.withColumn("whole", whole).select("x", "y", "whole", "x_weight", "y_weight", "x_head", "y_head"), "tile-pairs")
    compare = met.filter("not whole").select("x", "y")
    sides = compare.select(F.col("x").alias("name"), "x", "y", F.lit(0).alias("side")).unionByName(compare.filter("x <> y").select(F.col("y").alias("name"), "x", "y", F.lit(1).alias("side")))
    both = sides.join(tiled, "name").select("x", "y", "side", "c", "copies", "v")
    compared = both.repartition("x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(_compare(axes, threshold), "a long, b long, links long")
    compared = materialize(compared, "vector-links")
    # Pairs of tiles that link throughout: every row has the other tile's vectors, and its head for a neighbour.
    full = met.filter("whole")
    full = full.select(F.col("x").alias("name"), F.col("y_weight").alias("weight"), F.col("y_head").alias("head"), F.col("x_head").alias("own")).unionByName(full.select(F.col("y").alias("name"), F.col("x_weight").alias("weight"), F.col("x_head").alias("head"), F.col("y_head").alias("own")))
    more = materialize(name_of.join(full.groupBy("name").agg(F.sum("weight").alias("links"), F.min("head").alias("head")), "name").select("c", "links", "head"), "whole-links")
    counts = compared.filter("links >= 0").select(F.col("a").alias("c"), "links").unionByName(more.select("c", "links")).groupBy("c").agg(F.sum("links").alias("others"))
    edges = compared.filter("links < 0").select("a", "b").unionByName(more.select(F.col("c").alias("a"), F.col("head").alias("b"))).unionByName(full.select(F.col("own").alias("a"), F.col("head").alias("b")))
    extra = shared_ids(of)
    parts = materialize(components(edges if extra is None else edges.unionByName(extra)), "vector-components")
    out = of.join(counts, "c", "left").join(least_ids(parts, classes), "c", "left")
    linked_ = out.select("k", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("reached", "least").alias("comp"))
    alone = rows.filter("not ok").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("comp"))
    done = linked_.unionByName(alone)
    return done.select(id_out("k").alias("vec_id"), "n_links", id_out("comp").alias("component_id"), (F.col("k") == F.col("comp")).alias("kept"))
