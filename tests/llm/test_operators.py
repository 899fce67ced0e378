"""Every operator against its straightforward version, on texts that hold the awkward cases."""

import itertools
import random
import string
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import bpe, components, embeddings, encoding, linededup, minhash, packing, quality, sstable, suffixarray, suffixdedup, toxicity, warc
from quarryline.llm.queries import tokenizer
from tests.llm import brute

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, k string, t int, keep double, lang string"


def texts(seed=3):
    """(doc_id, text): copies, near copies, shared passages, one long text, odd characters, null and empty."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", ".", ",\n"]) for _ in range(n))
    base, passage = prose(160), prose(70)
    rows = [base, base, base.replace(" ", "  ", 2), None, "", " \n\t ", "one two", "ONE two", "a" * 5000, "é" * 400 + "日本語 テキスト " * 40, "<|endoftext|> x <|endoftext|>", "tab\tsep\x1cchar\x85 end", "ΑΣ İ ǅ ﬁ"]
    for _ in range(14):
        w = base.split(" ")
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [prose(40) + passage + prose(30) for _ in range(5)] + [passage, passage + "\n" + passage, prose(3000), "\n".join(["the same line here"] * 9), "x\n" + "\n".join(["The Same line here  ", "short", "another shared line"] * 3)]
    rows += ["another shared line\nthe same LINE here", "b c d e f g h", "b c d e f g h i"]
    return [(i * 3 - 20, t) for i, t in enumerate(rows)]


ROWS = texts()


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 0.5, "en") for k, t in rows], SCHEMA).repartition(3)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_codec_matches_the_library():
    for name in (BYTE, WORD):
        lib, ids = brute.ids_of(name, [t for _, t in ROWS])
        code = bpe.codec(tokenizer(name))
        for (_, t), want in zip(ROWS, ids):
            assert np.frombuffer(code.encode(t), "<u4").tolist() == want
            if name == BYTE:
                assert code.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_every_code_point_is_cut_as_the_library_does():
    lib = {n: brute.ids_of(n, [])[0] for n in (BYTE, WORD)}
    r = random.Random(1)
    for name in (BYTE, WORD):
        code = bpe.codec(tokenizer(name))
        for c in [*range(0, 0x2200), *r.sample(range(0x2200, 0x20000), 3000)]:
            if not 0xD800 <= c < 0xE000:
                s = f"a{chr(c)}b {chr(c)}1"
                assert np.frombuffer(code.encode(s), "<u4").tolist() == lib[name].encode(s, add_special_tokens=False).ids, hex(c)


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    words = {w.encode(): [i, 2 * i, 7] for i, w in enumerate(["station", "nation", "ration", "at", "a", "nations", "é", ""])}
    bpe.Lexicon.build(str(tmp_path / "l.bin"), words.items())
    lex = bpe.Lexicon(str(tmp_path / "l.bin"))
    for w, ids in words.items():
        assert np.frombuffer(lex.get(w), "<u4").tolist() == ids
    assert lex.get(b"nat") is None and lex.get(b"zz") is None
    asked = [*words, b"nat", b"zz", b"", b"stations", "é".encode()[:1], b"nationsx"]
    ranks = lex.ranks(np.frombuffer(b"".join(asked), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in asked]))))
    order = sorted(words)
    assert ranks.tolist() == [order.index(w) if w in words else -1 for w in asked]
    assert lex.n_nodes < sum(map(len, words))


def test_encoding(spark):
    df, path = frame(spark, ROWS), tokenizer(BYTE)
    lexicon = encoding.build_lexicon(df, path, size=50)
    assert rows_of(encoding.digests(df, path, lexicon), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.codec(ROWS)
    both = encoding.decode(encoding.encode(df, path, lexicon), path)
    assert {r.doc_id: r.decoded for r in both.collect()} == {k: t or "" for k, t in ROWS}
    clash = encoding.decode(encoding.encode(spark.createDataFrame([(None, "a b", 7, "x"), (None, None, 8, "y")], "doc_id long, text string, ids int, decoded string"), path, lexicon), path, "_ids")
    assert clash.columns == ["doc_id", "text", "ids", "decoded", "_ids", "_decoded"]
    assert sorted((r.ids, r.decoded, r._decoded) for r in clash.collect()) == [(7, "x", "a b"), (8, "y", "")]
    assert [x[0] for x in rows_of(encoding.digests(frame(spark, [(None, "a"), (None, "a"), (1, None)]), path, lexicon), "doc_id", "n_tokens")] == [None, None, 1]
    assert encoding.digests(frame(spark, [])[["doc_id", "text"]], path, encoding.build_lexicon(frame(spark, []), path)).count() == 0


def test_many_texts_at_once(tmp_path, monkeypatch):
    """Grouped lookups give the library's ids, whatever part of the pieces the lexicon holds."""
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 50)
    for name in (BYTE, WORD):
        plain, want = bpe.codec(tokenizer(name)), brute.ids_of(name, [t for _, t in ROWS])[1]
        every = sorted({p for _, t in ROWS if t for p in plain.parts(t)})
        for some in (every[::2], every, []):
            bpe.Lexicon.build(str(tmp_path / "l.bin"), [(p.encode(), np.frombuffer(plain.merge(p), "<u4").tolist()) for p in some])
            code = bpe.Codec(tokenizer(name), str(tmp_path / "l.bin"))
            assert [x.tolist() for x in code.encode_many(t for _, t in ROWS)] == want
        assert [x.tolist() for x in plain.encode_many(t for _, t in ROWS)] == want


def test_packing(spark):
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = rows_of(packing.pack(frame(spark, ROWS), tokenizer(BYTE)), *cols)
    n, tokens = brute.check_packing(ROWS, out)
    assert n <= tokens // 1024 + 4
    small = rows_of(packing.pack(frame(spark, ROWS), tokenizer(BYTE), block_tokens=3000), *cols)
    brute.check_packing(ROWS, small)
    assert packing.pack(frame(spark, []), tokenizer(BYTE)).count() == 0
    assert packing.pack(frame(spark, [(None, None), (None, "a")]), tokenizer(BYTE)).count() == 2


def test_assignment_balances_costs():
    r = random.Random(5)
    lengths = [r.randint(1, 400) for _ in range(400)]
    pieces, n = packing.assign(lengths, 1024)
    cost = [0.0] * n
    for _, _, take, seq, _ in pieces:
        cost[seq] += packing.LINEAR * take + packing.QUADRATIC * take * take
    assert n == -(-sum(lengths) // 1024) and max(cost[:-1]) < 1.25 * sorted(cost)[n // 2]


def test_sstable(spark, tmp_path, monkeypatch):
    df = frame(spark, ROWS)
    _, manifest = sstable.write_shards(df, tokenizer(WORD), 1)
    cols = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(sstable.read_shards(spark, manifest), *cols) == brute.sstable(ROWS)
    _, m = sstable.write_shards(frame(spark, []), tokenizer(WORD), 1)
    assert sstable.read_shards(spark, m).count() == 0
    _, m = sstable.write_shards(frame(spark, [(None, "b"), (2, "x"), (2, "a"), (None, None)]), tokenizer(WORD), 1)
    assert [r[0] for r in rows_of(sstable.read_shards(spark, m), *cols)] == [None, None, 2, 2]
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    monkeypatch.setattr(sstable, "ROLL_BYTES", 400)
    pieces = []
    source = iter([(k, bytes(range(4 * (k % 5)))) for k in range(300)])
    for i, one in enumerate(source):
        sstable.write_shard(str(tmp_path / f"p{i}.sst"), itertools.chain((one,), source))
        pieces.append(sstable.Shard(str(tmp_path / f"p{i}.sst")))
    assert len(pieces) > 3 and [r for p in pieces for r in p] == [(k, bytes(range(4 * (k % 5)))) for k in range(300)]
    monkeypatch.undo()
    rows = [(k, np.arange(k % 50 + 70000 * (k % 3 == 0), dtype="<u4").tobytes()) for k in range(-300, 300, 3)] + [(299, b"\1\0\0\0")]
    sstable.write_shard(str(tmp_path / "s.sst"), iter(rows))
    shard = sstable.Shard(str(tmp_path / "s.sst"))
    assert list(shard) == rows and all(shard.get(k) == [v for x, v in rows if x == k] for k in range(-310, 310))
    assert sum(shard.maybe(k) for k in range(10_000, 12_000)) < 100


def test_warc(spark):
    rows = [(i, t) for i, t in enumerate(["<p>a</p>", "<p>a</p>", None, "", "é€", "x" * 300_000, "<p>a</p>"])]
    df = spark.createDataFrame([(k, f"http://e.x/{k}\r\nX: y é" if k % 2 else None, h, "z") for k, h in rows], "page_id long, url string, html string, ref string").repartition(3)
    manifest = warc.write_archives(df)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(warc.index(spark, manifest), *cols) == brute.warc(rows)
    for r in warc.read_archives(spark, manifest).collect():
        assert r.record_type == "revisit" or bytes(r.payload).decode() == (rows[r.page_id][1] or "")
        assert r.url == (f"http://e.x/{r.page_id}\r\nX: y é" if r.page_id % 2 else None)
    assert warc.index(spark, warc.write_archives(df.limit(0))).count() == 0
    # Null and repeated ids.
    odd = [(None, "http://a/%20x", "<p>a</p>"), (None, "http://b/ y", "b"), (3, "u", "<p>a</p>"), (3, "u", "<p>a</p>"), (3, "v", "c"), (1, "w", "<p>a</p>")]
    manifest = warc.write_archives(spark.createDataFrame(odd, "page_id long, url string, html string").repartition(2))
    got = rows_of(warc.read_archives(spark, manifest), "page_id", "url", "payload_bytes", "record_type", "refers_to")
    assert got == [(None, "http://a/%20x", 8, "revisit", 3), (None, "http://b/ y", 1, "response", None), (1, "w", 8, "revisit", 3), (3, "u", 8, "response", None), (3, "u", 8, "response", None), (3, "v", 1, "response", None)]


def test_near_duplicates(spark):
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash.near_components(frame(spark, ROWS)), *cols) == brute.near(ROWS)
    assert minhash.near_components(frame(spark, [])).count() == 0
    again = rows_of(minhash.near_components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None)])), *cols)
    assert again == [(None, 2, None, True), (4, 2, None, False), (4, 2, None, False), (9, 0, 9, True)]


def test_near_duplicates_under_shared_ids(spark):
    """Every text of an id links, whatever other texts the id has."""
    r = random.Random(21)
    a, b, d = ([f"w{r.randrange(10**6)}" for _ in range(120)] for _ in range(3))
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    shared = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 60)), (3, near(b, 60)), (7, " ".join(d))]
    assert [x[::2] for x in rows_of(minhash.near_components(frame(spark, shared)), *cols)] == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]
    # The id is shared by rows whose classes have smaller ids; one without words stays alone.
    through = [(3, " ".join(a)), (5, " ".join(a)), (4, " ".join(b)), (5, " ".join(b)), (5, None), (6, near(b, 9)), (7, " ".join(d)), (8, near(d, 40)), (8, near(d, 40))]
    got = rows_of(minhash.near_components(frame(spark, through)), *cols)
    assert sorted(x[::2] for x in got if x[1]) == [(3, 3), (4, 3), (5, 3), (5, 3), (6, 3), (7, 7), (8, 7), (8, 7)] and (5, 0, 5, True) in got
    assert [x[0] for x in got if x[3]] == [3, 5, 7]


def test_near_duplicates_of_a_large_bucket(spark, monkeypatch):
    """Texts that share a boilerplate meet in buckets and aren't similar: hubs in several rounds lose no link."""
    monkeypatch.setattr(minhash, "MOST_HUBS", 6)
    r = random.Random(4)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(14):
        own = common + [f"w{r.randrange(10**6)}" for _ in range(40)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(["x", *own[1:]]))]
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash.near_components(frame(spark, rows)), *cols) == brute.near(rows)


def test_near_duplicates_of_a_drifting_family(spark):
    """Neighbours are similar, the ends are not: stars alone would lose links."""
    r = random.Random(11)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(w)
        w[(i * 5) % 200] = f"n{i}"
        rows.append((i, " ".join(w)))
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash.near_components(frame(spark, rows)), *cols) == brute.near(rows)


def check_embeddings(rows, df):
    """rows: (vec_id, vector, label), ids unique."""
    good = {i: np.array(x) for i, x, lab in rows if lab is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    comp, n = brute.components([i for i, _, _ in rows], links), Counter(x for p in links for x in p)
    assert rows_of(embeddings.near_components(df), "vec_id", "n_links", "component_id", "kept") == sorted((i, n[i], comp[i], comp[i] == i) for i, _, _ in rows)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    v = [(b + r.normal(scale=0.02 + 0.1 * (i % 3), size=16)).tolist() for i in range(6) for b in base] + [base[0].tolist()] * 3 + [[0.0] * 16, None, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [2.0, 4.0], []]
    rows = [(i, x, None if i % 29 == 3 else i % 2) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    check_embeddings(rows, df)
    assert embeddings.near_components(df.limit(0)).count() == 0


def test_embeddings_in_many_tiles(spark, monkeypatch):
    """Cells of several levels, tiles cut by a hash, a hot group that is counted whole, blocks."""
    monkeypatch.setattr(embeddings, "TILE_BYTES", 0)
    monkeypatch.setattr(embeddings, "LEAST_ROWS", 30)
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(embeddings, "LEVELS", 4)
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 8)) * np.array([3, 2, 1, 1, 0.5, 0.5, 0.3, 0.3])
    v = [b + r.normal(scale=s, size=8) for b in base for s in (0.02, 0.05, 0.1, 0.15, 0.3)] + [base[0] + r.normal(scale=0.01, size=8) for _ in range(150)]
    rows = [(3 * i - 100, x.tolist(), int(i % 7 == 0)) for i, x in enumerate(v)]
    check_embeddings(rows, spark.createDataFrame(rows, VECTORS).repartition(3))


def test_embeddings_of_null_and_shared_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(None, a, 1), (5, near(a), 1), (5, b, 1), (7, near(b), 1), (7, near(b), 1), (8, c, 1), (9, near(c), 2), (9, None, 2)]
    got = rows_of(embeddings.near_components(spark.createDataFrame(rows, VECTORS).repartition(2)), "vec_id", "n_links", "component_id", "kept")
    assert got == [(None, 1, None, True), (5, 1, None, False), (5, 2, None, False), (7, 2, None, False), (7, 2, None, False), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True)]


def test_suffix_array():
    r = random.Random(1)
    for _ in range(1500):
        x = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffixarray.suffix_array(np.array(x, int)) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_dedup(spark, monkeypatch):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffixdedup.digests(frame(spark, ROWS)), *cols) == brute.suffix(ROWS)
    assert suffixdedup.digests(frame(spark, [])).count() == 0
    kept = {r.doc_id: r.text for r in suffixdedup.dedup(frame(spark, ROWS)).collect()}
    assert set(kept) == {k for k, _ in ROWS} and all(kept[k] is None for k, t in ROWS if t is None)
    assert suffixdedup.dedup(frame(spark, ROWS)).columns == SCHEMA.replace("long", "").split()[0:1] + ["text", "k", "t", "keep", "lang"]


def test_suffix_dedup_blocks_and_hot_anchors(monkeypatch):
    """The parts that large inputs reach: texts in blocks, anchors with many runs."""
    monkeypatch.setattr(suffixdedup, "BLOCK", 500)
    monkeypatch.setattr(suffixdedup, "GROUP", 1)
    docs = pa.RecordBatch.from_pydict({"k": [k for k, _ in ROWS], "t": [0] * len(ROWS), "text": [t or "" for _, t in ROWS]})
    order = lambda b, by: pa.Table.from_batches(list(b)).sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches(max_chunksize=37)
    marks = pa.Table.from_batches(list(suffixdedup._repeats(iter(order(suffixdedup._anchors(np.empty(0, np.int64))(iter([docs])), ["a", "s", "k", "t", "st"]))))).to_pylist()
    assert any(m["kind"] == 3 for m in marks)
    want = [{"kind": 0}] and [[{c: m[c] for c in ("kind", "a", "st", "n", "o")} for m in marks if m["k"] == k and m["kind"] > 1] for k, _ in ROWS]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("st", pa.int32()), ("n", pa.int32()), ("o", pa.int32())]))
    asked = pa.RecordBatch.from_arrays([*docs.columns, pa.array(want, kind)], ["k", "t", "text", "want"])
    spans = [s for b in suffixdedup._settle(iter(order(suffixdedup._cut(iter([asked])), ["a", "h", "data", "k", "t", "st"]))) for s in b.to_pylist()]
    out = []
    for k, t in sorted(ROWS):
        mine = [(m["st"], m["n"]) for m in marks if m["kind"] == 1 and m["k"] == k] + [(s["st"], s["n"]) for s in spans if s["k"] == k]
        data = (t or "").encode()
        kept, gone, n = suffixdedup.cut_out(data, np.array([a for a, _ in mine], int), np.array([b for _, b in mine], int)) if mine else (data, 0, 0)
        out.append((k, len(data), gone, n, brute.sha(kept)))
    assert out == brute.suffix(ROWS)


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    """A passage in most texts: its anchors are spread, its edges settled by windows."""
    r = random.Random(6)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(20)) + " " + passage[: 300 + i % 7] + " ".join(word() for _ in range(20))) for i in range(120)]
    monkeypatch.setattr(suffixdedup, "SHARE", 400)
    text = spark.createDataFrame([(k, 0, t) for k, t in rows], "k long, t long, text string")
    hot = suffixdedup.hot_anchors(text, 20)
    assert 0 < len(hot) < 400
    monkeypatch.setattr(suffixdedup, "hot_anchors", lambda docs: hot)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffixdedup.digests(frame(spark, [*rows, rows[0], rows[7]])), *cols) == sorted([*(w := brute.suffix(rows)), w[0], w[7]])


def test_shared_windows_against_plain_comparison():
    r = random.Random(9)
    for _ in range(60):
        base = bytes(r.choice(b"ab") for _ in range(150))
        entries = []
        for _ in range(r.randint(1, 6)):
            o = r.randint(0, 60)
            x = bytearray(base[60 - o : 60 - o + r.randint(100, 90 + o if o > 10 else 100)])
            if r.random() < 0.5:
                x[r.randrange(len(x))] ^= 1
            entries.append((o, bytes(x)))
        e, w = suffixdedup.shared_windows(entries)
        # Windows of entries at one distance to the anchor.
        seen, want = set(), set()
        for i, (o, x) in enumerate(entries):
            for p in range(len(x) - 99):
                key = (o - p, x[p : p + 100])
                if key in seen:
                    want.add((i, p))
                seen.add(key)
        assert want <= set(zip(e.tolist(), w.tolist()))
        assert all(any(x[p : p + 100] in y for _, y in entries[:i]) or x.find(x[p : p + 100]) < p for i, p in zip(e.tolist(), w.tolist()) for x in [entries[i][1]])


def test_suffix_dedup_of_repeated_rows(spark, monkeypatch):
    """Rows repeated in full, in other partitions or batches, are one document; each gets its result."""
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = [*ROWS, (None, "y" + ROWS[0][1])]
    single = rows_of(suffixdedup.digests(frame(spark, rows)), *cols)
    want = brute.suffix([(k if k is not None else -(10**9), t) for k, t in rows])
    assert single == [(None, *want[0][1:]), *want[1:]]
    again = frame(spark, rows).union(frame(spark, rows[::-1])).union(frame(spark, [r for r in rows for _ in range(2)]))
    assert rows_of(suffixdedup.digests(again), *cols) == [r for r in single for _ in range(4)]
    alone = frame(spark, [ROWS[0]]).union(frame(spark, [ROWS[0]]))
    assert [r.text for r in suffixdedup.dedup(alone).collect()] == [ROWS[0][1]] * 2
    # Anchors with many runs, whose windows travel one by one.
    monkeypatch.setattr(suffixdedup, "GROUP", 1)
    docs = pa.RecordBatch.from_pydict({"k": [k for k, _ in ROWS], "t": [0] * len(ROWS), "text": [t or "" for _, t in ROWS]})
    order = lambda b, by: pa.Table.from_batches(list(b)).sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches(max_chunksize=37)
    found = []
    for copies in (1, 3):
        marks = pa.Table.from_batches(list(suffixdedup._repeats(iter(order(suffixdedup._anchors(np.empty(0, np.int64))(iter([docs] * copies)), ["a", "s", "k", "t", "st"]))))).to_pylist()
        want = [[{c: m[c] for c in ("kind", "a", "st", "n", "o")} for m in marks if m["k"] == k and m["kind"] > 1] for k, _ in ROWS]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("st", pa.int32()), ("n", pa.int32()), ("o", pa.int32())]))
        asked = pa.RecordBatch.from_arrays([*docs.columns, pa.array(want, kind)], ["k", "t", "text", "want"])
        spans = [s for b in suffixdedup._settle(iter(order(suffixdedup._cut(iter([asked] * copies)), ["a", "h", "data", "k", "t", "st"]))) for s in b.to_pylist()]
        mine = [m for m in marks if m["kind"] == 1] + spans
        found.append({(m["k"], x) for m in mine for x in range(m["st"], m["st"] + m["n"])})
    assert found[0] == found[1]


def test_line_dedup(spark):
    cols = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert rows_of(linededup.digests(frame(spark, ROWS)), *cols) == brute.lines(ROWS)
    assert linededup.digests(frame(spark, [])).count() == 0
    hot = [(i, f"the line everybody has\nown line number {i}") for i in range(200)]
    assert rows_of(linededup.digests(frame(spark, hot)), *cols) == brute.lines(hot)
    out = {r.doc_id: r for r in linededup.dedup(frame(spark, [(None, "ten characters"), (1, "ten characters\nx"), (2, None)])).collect()}
    assert out[None].text == "ten characters" and out[1].text == "x" and out[2].text is None and out[1].keep == 0.5


def test_quality(spark):
    df = quality.judge(frame(spark, ROWS))
    got = rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == brute.base(ROWS)
    assert all(not (r.kept and r.base_failed) for r in df.collect())
    assert quality.judge(frame(spark, [])).count() == 0
    r = random.Random(2)
    words = ["the", "of", "and", "houses", "river", "it", "stone", "walked", "was", "green", "is", "evening"]
    clean = [(i, " ".join(r.choice(words) + str(r.choice(["", "", "s", "ed"])) for _ in range(150)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(r.choice(words) + "$$$ ###" for _ in range(150))) for i in range(12)]
    kept = {x.doc_id: x.kept for x in quality.judge(frame(spark, clean + junk)).collect()}
    assert all(kept[k] for k, _ in clean) and not any(kept[k] for k, _ in junk)
    # Mostly junk: the share of good documents is estimated, not held above some bound.
    junk = [(100 + i, " ".join(r.choice(words) + "$$$ ###" for _ in range(150))) for i in range(300)]
    judged = quality.judge(frame(spark, clean + junk))
    kept = {x.doc_id: x.kept for x in judged.collect()}
    assert all(kept[k] for k, _ in clean) and not any(kept[k] for k, _ in junk)
    assert 0.1 < quality.estimate(judged)[0] < 0.3
    # A long text of few words gets no vote for its variety.
    long = quality.judge(frame(spark, [(1, "one two three four " * 1000), (2, " ".join(f"w{i % 700}" for i in range(5000))), (None, "one two"), (None, "one two")])).collect()
    assert {x.doc_id: x.v_distinct for x in long if x.doc_id} == {1: -1, 2: 1} and len(long) == 4


def test_quality_estimates_and_verdicts(spark):
    """EM and posterior against plain Python."""
    r = random.Random(5)
    words = ["the", "of", "and", "houses", "river", "it", "stone", "WALKED", "was", "green"]
    rows = []
    for i in range(150):
        bad, n = r.random() < 0.3, r.randint(45, 120)
        w = [r.choice(words[:3] if bad and r.random() < 0.5 else words) + ("$#" if bad and r.random() < 0.5 else r.choice(["", "s", "ed"])) for _ in range(n)]
        rows.append((i, " ".join(x.upper() if bad and i % 3 == 0 else x for x in w)))
    out = quality.judge(frame(spark, rows)).collect()
    votes = {x.doc_id: tuple(x[f"v_{n}"] for n in quality.RULES) for x in out}
    patterns = Counter(votes.values())
    assert len(patterns) > 5
    want = quality.ordered(brute.em(patterns, quality.ITERATIONS, (quality.START_GOOD, quality.START_ON_GOOD, quality.START_ON_BAD), quality.PRIOR_SHARE, quality.PRIOR_ON_GOOD, quality.PRIOR_ON_BAD))
    m = len(quality.RULES)
    p = {k: brute.posterior(v, want[0], want[1 : 1 + m], want[1 + m :]) for k, v in votes.items()}
    assert all(abs(x.p_quality - p[x.doc_id]) < 1e-6 for x in out)
    assert all(x.kept == (not x.base_failed and p[x.doc_id] >= quality.KEEP) for x in out) and {x.kept for x in out} == {True, False}
    swapped = quality.ordered([0.2, *[0.1] * m, *[0.1] * m])
    assert swapped[0] == 0.8 and swapped[1] == swapped[-1] == 0.9


def test_quality_runs_without_python(spark):
    plan = quality.judge(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity(spark):
    r = random.Random(4)
    clean = ["house", "river", "stone", "green", "evening", "walk", "garden", "little", "window", "morning"]
    bad = ["idiot", "moron", "trash"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(2001, "green house you 1d10t evening"), (2002, "river i d i o t stone"), (2003, "walk mmooorrrooonnn garden little"), (2004, "tr@sh window"), (2005, "little window morning"), (2006, None), (2007, "")]
    df = frame(spark, rows + odd)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score(df, toxicity.train(df, lab)).collect()}
    assert len(out) == len(rows) + len(odd)
    assert all(out[i].predicted == y for i, y in labels)
    assert [out[i].predicted for i, _ in odd] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= x.score <= 1 for x in out.values()) and sum(x.held_out for x in out.values()) > 100
    none = toxicity.score(df, toxicity.train(df, lab.limit(0)))
    assert none.agg({"score": "max"}).first()[0] < 0.3


def test_toxicity_behind_long_runs_and_in_long_tokens():
    """Words count wherever they stand in a letter-spaced text or a joined token, and decoding takes linear time."""
    clean = ["house", "river", "stone", "green", "evening", "garden"] * 60
    counts = toxicity.word_counts([*clean, "idiot", "idiot"] * 20)
    s = toxicity.Scorer(-np.log(toxicity.model(counts)), {"idiot": 3.0}, [-3.0, 4.0, 1.0, 0.0, 0.0], 0.1)
    plain = "".join(clean)
    assert s.measure(" ".join(plain[:200] + "idiot"))[1] > 0
    assert s.measure(" ".join(plain))[1] == 0
    assert s.measure(" ".join(plain + "idiot"))[1] > 0 and s.measure(" ".join(plain + "idiot" + plain))[1] > 0
    for joint in "._-":
        assert s.measure(joint.join(plain + "idiot"))[1] > 0, joint
        assert s.measure(joint.join([*clean, "1d10t"]))[1] > 0 and s.measure(joint.join(clean))[1] == 0, joint
    words = toxicity._document_words(s.restorer, " ".join(plain + "idiot"))[0]
    assert "".join(words).endswith("idiot")
    for odd in ("1", "a", "*", "i.", "1!|", "a1"):
        start = time.perf_counter()
        s.restorer.restore(odd * (40_000 // len(odd)))
        assert time.perf_counter() - start < 20, odd


def test_decoding_against_all_paths():
    """Viterbi finds a path of least cost among all of the lattice."""
    counts = toxicity.word_counts(["idiot", "house", "moron", "stone", "trash", "it", "to"] * 30)
    costs = -np.log(toxicity.model(counts))
    r = random.Random(12)

    def cheapest(observed):
        paths = [(0.0, "", 0, 0)]
        last = ""
        for ch in observed:
            options = [(ch, 0.0)] if ch.isalpha() else [(" ", 0.0 if ch == " " else toxicity.BREAK_COST)]
            options += [(x, toxicity.LEET_COST) for x in toxicity.LEET.get(ch, "")]
            if ch in toxicity.SEPARATORS:
                options.append(("", toxicity.SEPARATOR_COST))
            elif ch == last or toxicity.LEET.get(ch, "~")[0] == last:
                options.append(("", toxicity.REPEAT_COST))
            last = ch
            new = []
            for cost, text, a, b in paths:
                for emit, price in options:
                    if not emit:
                        new.append((cost + price, text, a, b))
                    else:
                        e = toxicity._CLASS.get(emit, 0 if emit == " " else toxicity.CLASSES - 1)
                        step = cost + price + costs[0 if b == 0 else a, b, e]
                        new.append((step, text + emit, *((0, 0) if e == 0 else (b, e))))
            paths = new
        return min((cost + costs[0 if b == 0 else a, b, 0], text) for cost, text, a, b in paths)

    restorer = toxicity.Restorer(costs)
    for _ in range(150):
        observed = "".join(r.choice("idotmrnhsu1003$@ .-*!") for _ in range(r.randint(1, 8)))
        assert restorer.restore(observed) == cheapest(observed)[1], observed
    assert restorer.restore("1d10t") == "idiot" and restorer.restore("i d i o t") == "idiot"


def test_toxicity_of_null_and_repeated_rows(spark):
    df = frame(spark, [(None, "you awful"), (None, "you awful"), (None, None), (3, ""), (3, "you awful")])
    lab = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, lab)).collect()
    assert len(out) == 5 and len({x.score for x in out}) == 1 and not any(x.held_out for x in out if x.doc_id is None)
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), lab)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    import zlib

    df = frame(spark, [(i, "plain words only" + (" awful" if i % 2 else "")) for i in range(400)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, toxic int")
    assert toxicity.train(df, lab).beta is None


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 60)]
    want = brute.components({x for p in e for x in p}, e)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_written_tables_go_when_nothing_reads_them(spark):
    import os

    from quarryline.llm import common

    folder = f"{common.posix(common.shared_dir(spark))}/quarryline"
    there = lambda: set(os.listdir(folder)) if os.path.exists(folder) else set()
    before = there()

    @common.tidy
    def inner(df):
        a = common.materialize(df, "inner-a")
        return common.materialize(a.filter("id > 1"), "inner-b"), a.count()

    @common.tidy
    def outer(df):
        b, n = inner(df)
        return b.join(common.materialize(b.withColumn("n", b.id * n), "outer-c"), "id")

    @common.tidy
    def number(df):
        return common.materialize(df, "number").count()

    out = outer(spark.range(4))
    left = sorted(x.rsplit("-", 1)[0] for x in there() - before)
    assert left == ["inner-b", "outer-c"] and sorted((r.id, r.n) for r in out.collect()) == [(2, 8), (3, 12)]
    assert number(spark.range(3)) == 3 and sorted(x.rsplit("-", 1)[0] for x in there() - before) == left
