"""Removal of bytes covered by a string of ``LENGTH`` bytes that also starts earlier, over all texts.

1. Anchors. In each window of LENGTH bytes the least hashed K-gram (the leftmost, if tied) is its anchor; equal windows
   have equal anchors at equal places. Neighbouring windows with one anchor are a run, about 30 windows; a task
   sends a run as two hashes, of the anchor and of the whole run, with its document and position. Within a batch a
   run that occurred earlier is settled at once and not sent as a candidate. A pass before finds the anchors that
   hold a large share of all runs; theirs are spread over tasks by the hash of the run.
2. Whole runs. Sorted by anchor, run, document and position, every run but the first of its kind is a repeat: the inside
   of a repeated passage needs no bytes. Different runs of one anchor may still share windows (where passages
   begin, end or differ): these first runs go on, with their bytes.
3. Suffix arrays. The runs of an anchor meet in one task as sequences of 8-byte symbols aligned to the anchor; a suffix array
   (linear grouping, ``suffixarray.py``) groups suffixes with 88 equal bytes, and the windows of a group whose other
   12 bytes are equal too are repeats but for the earliest. An anchor with more than ``GROUP`` different runs would
   not fit a task: its windows go on one by one with their bytes, to tasks that a hash of them names, and are sorted there.
   Either way bytes decide, not hashes.
4. Repeats become intervals per document, and the texts meet them in one shuffle.

Texts are their UTF-8 bytes, null is empty; matches don't cross texts. Order is (doc_id, position); rows that share
an id are ordered by a hash of their texts, and rows repeated in full are one document (each gets its result). A null id is the
smallest. An empty table gives no rows; other columns are kept by ``dedup`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import free_name, id_in, id_out, materialize, tidy
from quarryline.llm.minhash import mix, powers, prefix_hash
from quarryline.llm.suffixarray import suffix_array

LENGTH, K = 100, 40
WINDOWS = LENGTH - K + 1
BLOCK = 1 << 20
GROUP = 4096
SYMBOLS = 1 << 16
#: Runs a task looks at together, and windows.
AT_ONCE, WINDOWS_AT_ONCE = 400_000, 50_000
#: An anchor with more than one in so many of all runs is spread over tasks; there are fewer than this many.
SHARE = 8192
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _slide_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[: len(a) - span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def runs(data: bytes, base: int = 0) -> tuple[np.ndarray, ...]:
    """anchor hash, run hash, first window, windows, anchor's distance from the first window's start."""
    x = np.frombuffer(data, np.uint8)
    p = prefix_hash(x)
    _, inv = powers(len(x) + 1)
    n = len(x) - K + 1
    grams = mix((p[K:] - p[:-K]) * inv[:n])
    least = _slide_min((grams & ~_LOW) | np.arange(n, dtype=np.uint64), WINDOWS)
    place = (least & _LOW).astype(np.int64)
    s = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    e = np.concatenate((s[1:], [len(place)]))
    at = place[s]
    whole = mix((p[e - 1 + LENGTH] - p[s]) * inv[s] * _U(0x2545F4914F6CDD1D) + (at - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (e - s).astype(np.uint64))
    return grams[at].view(np.int64), whole.view(np.int64), s + base, e - s, at - s


def all_runs(data: bytes) -> tuple[np.ndarray, ...]:
    """The runs of a text of any length, in blocks of windows."""
    parts = [runs(data[b : b + BLOCK + LENGTH - 1], b) for b in range(0, max(1, len(data) - LENGTH + 1), BLOCK)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts))


def merge_spans(start: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join windows (start, number) that follow on each other within a key. Sorted by key and start."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(start)])) - 1
    return start[at], start[last] + n[last] - start[at], key[at]


RUN_NAMES = ["kind", "a", "s", "k", "t", "st", "n", "o"]
RUN_SCHEMA = "kind int, a long, s long, k long, t long, st int, n int, o int"


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)


def _batches_of_runs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """row, anchor, run, first window, windows, distance: the runs of a batch (k, t, text) in the order of documents, many at once."""
    k, t = b.column(0).to_numpy(), b.column(1).to_numpy()
    order = np.lexsort((t, k))
    if len(order) > 1:  # rows repeated in full are one document
        same = (k[order][1:] == k[order][:-1]) & (t[order][1:] == t[order][:-1])
        order = order[np.concatenate(([True], ~same))]
    pending, size = [], 0
    for i in [*order.tolist(), -1]:
        if i >= 0:
            data = b.column(2)[i].as_py().encode()
            if len(data) >= LENGTH:
                r = all_runs(data)
                pending.append((np.full(len(r[0]), i), *r))
                size += len(r[0])
        if pending and (i < 0 or size > AT_ONCE):
            yield tuple(np.concatenate(c) for c in zip(*pending))
            pending, size = [], 0


def _first_runs(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    first = np.zeros(len(a), bool)
    first[np.unique(s ^ (a * np.int64(0x9E3779B97F4A7C1 | 1)), return_index=True)[1]] = True
    return first


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with many different runs among those seen together, with their number; the null anchor counts all."""
    for b in batches:
        for _, a, s, _, _, _ in _batches_of_runs(b):
            a = a[_first_runs(a, s)]
            found, n = np.unique(a, return_counts=True)
            # What is left out of an anchor's count is less than one in 16 * SHARE of all runs.
            keep = n * 16 * SHARE >= len(a)
            keep &= n > 1
            yield pa.RecordBatch.from_arrays([pa.array([*found[keep].tolist(), None], pa.int64()), pa.array([*n[keep].tolist(), len(a)], pa.int64())], ["a", "n"])


def hot_anchors(docs: DataFrame, least: int = GROUP) -> np.ndarray:
    """The anchors that hold more than one in ``SHARE`` of all runs, in order. docs: (k, t, text)."""
    n = docs.mapInArrow(_frequent, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    n = materialize(n, "anchor-counts")
    total = n.filter("a is null").agg(F.max("n")).first()[0] or 0
    most = max(total * 15 // (16 * SHARE), least)
    return np.array(sorted(r.a for r in n.filter("a is not null").filter(F.col("n") > most).collect()), np.int64)  # fewer than SHARE * 16 / 15 rows


def _anchors(hot: np.ndarray) -> Callable:
    """Runs: kind 0, the first of its kind in the batch; kind 4, such a one of a hot anchor; kind 1, windows that are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, a, s, st, n, o in _batches_of_runs(b):
                first = _first_runs(a, s)
                one = np.flatnonzero(first)
                kind = np.where(np.isin(a[one], hot), 4, 0).astype(np.int32)
                yield _batch(RUN_NAMES, kind, a[one], s[one], k[row[one]], t[row[one]], st[one].astype(np.int32), n[one].astype(np.int32), o[one].astype(np.int32))
                if len(one) < len(a):
                    st2, n2, row2 = merge_spans(st[~first], n[~first], row[~first])
                    z = np.zeros(len(st2), np.int32)
                    spread = mix(k[row2].view(np.uint64)).view(np.int64)
                    yield _batch(RUN_NAMES, z + np.int32(1), spread, t[row2], k[row2], t[row2], st2.astype(np.int32), n2.astype(np.int32), z)

    return run


def _copies(last: tuple[int, ...] | None, cols: list[np.ndarray]) -> np.ndarray:
    """Which sorted rows equal the one before them; ``last`` came before the first."""
    same = np.ones(len(cols[0]), bool)
    same[0] = last == tuple(int(x[0]) for x in cols)
    for x in cols:
        same[1:] &= x[1:] == x[:-1]
    return same


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs: kind 1, windows that are repeats; kinds 2 and 3, first runs of an anchor that has several, few or many."""
    last: tuple[int, ...] | None = None
    held: list[np.ndarray] | None = None  # first runs of the anchor that is open
    hot: int | None = None  # the open anchor, if it has many runs already

    def out(kind: int | np.ndarray, c: list[np.ndarray]) -> pa.RecordBatch:
        return _batch(RUN_NAMES, np.full(len(c[1]), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32), *c[1:])

    def close(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Complete anchors: those with several runs go on."""
        if not len(c[1]):
            return
        new = np.concatenate(([True], c[1][1:] != c[1][:-1]))
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))[np.cumsum(new) - 1]
        on = size > 1
        if on.any():
            yield out(np.where(size[on] > GROUP, 3, 2), [x[on] for x in c])

    for b in batches:
        if not b.num_rows:
            continue
        c = [x.to_numpy() for x in b.columns]
        a, s = c[1], c[2]
        first = np.concatenate(([last is None or last[:2] != (int(a[0]), int(s[0]))], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        # A run met again at its own place is a row repeated in full, from another batch: no repeat. (Kind 1 rows may differ in n.)
        copy = _copies(last, c[1:6]) & (c[0] != 1)
        last = tuple(int(x[-1]) for x in c[1:6])
        first, c = first[~copy], [x[~copy] for x in c]
        again = (c[0] == 1) | ~first
        if again.any():
            yield out(1, [x[again] for x in c])
        c = [x[~again] for x in c]
        spread = c[0] == 4
        if spread.any():
            yield out(3, [x[spread] for x in c])
            c = [x[~spread] for x in c]
        if hot is not None:
            more = c[1] == hot
            if more.any():
                yield out(3, [x[more] for x in c])
            if last[0] != hot:
                hot = None
            c = [x[~more] for x in c]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
            held = None
        if not len(c[1]):
            continue
        open_ = c[1] == last[0]
        yield from close([x[~open_] for x in c])
        if open_.any():
            held = [x[open_] for x in c]
            if len(held[1]) > GROUP:
                yield out(3, held)
                held, hot = None, last[0]
    if held is not None:
        yield from close(held)


CUT_NAMES = ["path", "a", "h", "k", "t", "st", "n", "o", "data"]
CUT_SCHEMA = "path int, a long, h long, k long, t long, st int, n int, o int, data binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs asked for: runs (path 2) or windows (path 3), with their bytes."""
    for b in batches:
        pending, size = [], 0
        for i in range(b.num_rows):
            k, t, data = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py().encode()
            want = b.column(3)[i].values
            kind, a, st, n, o = (want.field(j).to_numpy() for j in range(5))
            two = np.flatnonzero(kind == 2)
            for p in range(0, len(two), 20_000):
                q = two[p : p + 20_000]
                parts = [data[x : x + y + LENGTH - 1] for x, y in zip(st[q].tolist(), n[q].tolist())]
                full = lambda v, kind: pa.array(np.full(len(q), v, kind))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([full(2, np.int32), pa.array(a[q]), full(0, np.int64), full(k, np.int64), full(t, np.int64), pa.array(st[q]), pa.array(n[q]), pa.array(o[q]), pa.array(parts, pa.binary())], CUT_NAMES)
            for q in np.flatnonzero(kind == 3).tolist():
                m = int(n[q])
                x = np.frombuffer(data, np.uint8, m + LENGTH - 1, int(st[q]))
                p, (_, inv) = prefix_hash(x), powers(len(x) + 1)
                h = mix((p[LENGTH:] - p[:-LENGTH]) * inv[:m]).view(np.int64)
                pending.append((np.full(m, a[q]), h, np.full(m, k), np.full(m, t), int(st[q]) + np.arange(m), np.lib.stride_tricks.sliding_window_view(x, LENGTH)))
                size += m
                if size > WINDOWS_AT_ONCE:
                    yield from _windows(pending)
                    pending, size = [], 0
        if pending:
            yield from _windows(pending)


def _windows(pending: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Windows of anchors with many runs: path 3 with their bytes, but path 1 (settled) if they equal an earlier one here."""
    a, h, k, t, st, x = (np.concatenate(c) for c in zip(*pending))
    order = np.lexsort((st, t, k, h))
    a, h, k, t, st, x = (c[order] for c in (a, h, k, t, st, x))
    new = np.concatenate(([True], h[1:] != h[:-1]))
    copy = np.concatenate(([False], ~new[1:] & (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (st[1:] == st[:-1])))  # of a row repeated in full
    same = ~new & (x == x[np.flatnonzero(new)[np.cumsum(new) - 1]]).all(1) & ~copy
    on, done = np.flatnonzero(~same & ~copy), np.flatnonzero(same)
    full = lambda v, kind, q: pa.array(np.full(len(q), v, kind))
    raw = pa.array([r.tobytes() for r in x[on]], pa.binary())
    yield pa.RecordBatch.from_arrays([full(3, np.int32, on), pa.array(a[on]), pa.array(h[on]), pa.array(k[on]), pa.array(t[on]), pa.array(st[on].astype(np.int32)), full(1, np.int32, on), full(0, np.int32, on), raw], CUT_NAMES)
    if len(done):
        by = np.lexsort((st[done], t[done], k[done]))
        q = done[by]
        part = np.concatenate(([0], np.cumsum((k[q][1:] != k[q][:-1]) | (t[q][1:] != t[q][:-1]))))
        s, n, _ = merge_spans(st[q], np.ones(len(q), np.int64), part)
        at = q[np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (st[q][1:] != st[q][:-1] + 1))))]
        spread = mix(k[at].view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([full(1, np.int32, at), pa.array(spread), pa.array(spread), pa.array(k[at]), pa.array(t[at]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), full(0, np.int32, at), pa.nulls(len(at), pa.binary())], CUT_NAMES)


def shared_windows(entries: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, window) of windows that also occur in an earlier entry, or earlier in theirs.

    entries, in order: the anchor's distance from the start, and the bytes. Equal windows have their anchors at one place.
    """
    least = (LENGTH - 7) // 8  # whole symbols in a window, wherever it starts
    symbols, owner, begin, left, offsets, at = [], [], [], [], [], 0
    for e, (o, data) in enumerate(entries):
        r0 = o % 8
        n = (len(data) - r0) // 8
        symbols.append(np.frombuffer(data, "<u8", n, r0))
        symbols.append(np.zeros(1, np.uint64))
        owner.append(np.full(n + 1, e))
        begin.append(np.append(r0 + 8 * np.arange(n), -1))
        left.append(np.append(np.arange(n, 0, -1), 0))
        offsets.append(at)
        at += len(data)
    raw, owner, begin, left = np.concatenate(symbols), np.concatenate(owner), np.concatenate(begin), np.concatenate(left)
    rank = np.unique(raw, return_inverse=True)[1] + 1
    rank[begin < 0] = 0  # entries end with a symbol of their own, below all others
    sa = np.array(suffix_array(rank))
    sa = sa[left[sa] >= least]
    none = np.empty(0, np.int64)
    if len(sa) < 2:
        return none, none
    view = np.lib.stride_tricks.sliding_window_view(rank, least)
    same = (view[sa[1:]] == view[sa[:-1]]).all(1)  # neighbours in the array share the whole symbols of a window
    group = np.cumsum(np.concatenate(([True], ~same)))
    member = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    sa, group = sa[member], group[member]
    length, offsets = np.array([len(d) for _, d in entries]), np.array(offsets)
    x = np.frombuffer(b"".join(d for _, d in entries), np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for before in range(8):  # bytes of a window before its first whole symbol
        w, e = begin[sa] - before, owner[sa]
        ok = (w >= 0) & (w + LENGTH <= length[e])
        w, e, g = w[ok], e[ok], group[ok]
        if len(w) < 2:
            continue
        s = offsets[e] + w
        rest = LENGTH - 8 * least
        edge = np.zeros((len(s), 16), np.uint8)
        edge[:, :before] = x[s[:, None] + np.arange(before)]
        edge[:, before:rest] = x[s[:, None] + np.arange(before + 8 * least, LENGTH)]
        one, two = edge.view(np.uint64).T
        order = np.lexsort((w, e, two, one, g))
        w, e, g, one, two = (c[order] for c in (w, e, g, one, two))
        later = np.concatenate(([False], (g[1:] == g[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
        found.append((e[later], w[later]))
    return (np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found])) if found else (none, none)


SPAN_NAMES = ["k", "t", "st", "n"]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor, hash and bytes: repeats among windows, by their neighbours, and among runs, by suffix arrays."""
    held: list[tuple] = []  # anchor, k, t, st, o, data
    size = 0
    last: tuple | None = None

    def finish(groups: list[tuple]) -> Iterator[pa.RecordBatch]:
        groups.sort(key=lambda g: g[1:4])
        e, w = shared_windows([(g[4], g[5]) for g in groups])
        if len(e):
            k, t, st = (np.array([g[i] for g in groups], np.int64) for i in (1, 2, 3))
            order = np.lexsort((w, e))
            s, n, o = merge_spans(w[order], np.ones(len(w), np.int64), e[order])
            yield _batch(SPAN_NAMES, k[o], t[o], (st[o] + s).astype(np.int32), n.astype(np.int32))

    for b in batches:
        if not b.num_rows:
            continue
        path, a, h = (b.column(i).to_numpy() for i in range(3))
        done = np.flatnonzero(path == 1)
        if len(done):
            yield _batch(SPAN_NAMES, *(b.column(i).to_numpy()[done] for i in (3, 4, 5, 6)))
        three = np.flatnonzero(path == 3)
        if len(three):
            x = np.frombuffer(b"".join(b.column(8).take(pa.array(three)).to_pylist()), np.uint8).reshape(-1, LENGTH)
            place = [b.column(i).to_numpy()[three] for i in (3, 4, 5)]
            again = np.concatenate(([last is not None and last[0] == x[0].tobytes()], (x[1:] == x[:-1]).all(1)))
            copy = _copies(last and last[1:], place) & again  # the same window, of a row repeated in full
            last = (x[-1].tobytes(), *(int(v[-1]) for v in place))
            q = three[again & ~copy]
            if len(q):
                yield _batch(SPAN_NAMES, *(b.column(i).to_numpy()[q] for i in (3, 4, 5, 6)))
        two = np.flatnonzero(path == 2)
        cols = [b.column(i).to_numpy() for i in (3, 4, 5, 7)]
        for i in two.tolist():
            if held and held[-1][:4] == (a[i], *(c[i] for c in cols[:3])):
                continue  # the same run, of a row repeated in full
            if size > SYMBOLS and held[-1][0] != a[i]:
                yield from finish(held)
                held, size = [], 0
            data = b.column(8)[i].as_py()
            held.append((int(a[i]), *(int(c[i]) for c in cols), data))
            size += len(data) // 8
    if held:
        yield from finish(held)


@tidy
def repeated(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, and per document (k, t) with repeats the list of (st, n): windows that start earlier elsewhere."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(id_in(id_col).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = docs.mapInArrow(_anchors(hot_anchors(docs)), RUN_SCHEMA)
    spread = F.when(F.col("kind") == 4, F.col("s")).otherwise(F.lit(0))
    found = found.repartition("a", spread).sortWithinPartitions("a", "s", "k", "t", "st").mapInArrow(_repeats, RUN_SCHEMA)
    marks = materialize(found, "runs")
    want = marks.filter("kind > 1").groupBy("k", "t").agg(F.collect_list(F.struct("kind", "a", "st", "n", "o")).alias("want"))
    asked = docs.join(want, ["k", "t"]).select("k", "t", "text", "want").mapInArrow(_cut, CUT_SCHEMA)
    spans = asked.repartition("a", "h").sortWithinPartitions("a", "h", "data", "k", "t", "st").mapInArrow(_settle, "k long, t long, st int, n int")
    more = materialize(spans, "spans")
    every = marks.filter("kind = 1").select(*SPAN_NAMES).unionByName(more)
    return docs, materialize(every.groupBy("k", "t").agg(F.collect_list(F.struct("st", "n")).alias("spans")), "document-spans")


def cut_out(data: bytes, st: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes that stay, the number removed, and of maximal runs removed."""
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, st, 1)
    np.add.at(gone, st + n + LENGTH - 1, -1)
    stay = np.cumsum(gone)[:-1] == 0
    starts = np.flatnonzero(~stay & np.concatenate(([True], stay[:-1])))
    return np.frombuffer(data, np.uint8)[stay].tobytes(), int(len(data) - stay.sum()), len(starts)


def _apply(row: pa.RecordBatch, i: int, text: int, spans: int) -> tuple[bytes, bytes, int, int]:
    data = row.column(text)[i].as_py().encode()
    found = row.column(spans)[i]
    if not found.is_valid:
        return data, data, 0, 0
    return data, *cut_out(data, found.values.field(0).to_numpy(), found.values.field(1).to_numpy())


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, spans = repeated(df, id_col, text_col)
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_apply(b, i, 1, 2) for i in range(b.num_rows)]
            cols = [[len(d) for d, _, _, _ in done], [r for _, _, r, _ in done], [s for _, _, _, s in done]]
            sha = pa.array([hashlib.sha256(x).hexdigest() for _, x, _, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), sha], names)

    joined = docs.join(spans.hint("shuffle_hash"), ["k", "t"], "left").select("k", "text", "spans")
    out = joined.mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(id_out("k").alias("doc_id"), *names[1:])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated bytes removed from its texts; characters cut in part go as well. Untouched texts stay, null included."""
    _, spans = repeated(df, id_col, text_col)
    others, key = [c for c in df.columns if c not in (id_col, text_col)], free_name("k", df.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(id_in(id_col).alias("k"), F.xxhash64(text).alias("t"), F.col(text_col).cast("string").alias("x"), *[F.col(f"`{c}`").alias(f"x_{c}") for c in others])
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(1)[i].as_py() if not b.column(2)[i].is_valid else _apply(b, i, 1, 2)[1].decode("utf-8", "ignore") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), *b.columns[3:]], [key, text_col, *others])

    both = source.join(spans.hint("shuffle_hash"), ["k", "t"], "left").select("k", "x", "spans", *[f"`x_{c}`" for c in others])
    out = both.mapInArrow(run, ", ".join([f"{key} long", f"`{text_col}` string", *(f"`{c}` {kinds[c]}" for c in others)]))
    return out.select(*(id_out(key).alias(id_col) if c == id_col else F.col(f"`{c}`") for c in df.columns))
