"""Straightforward versions of the operators, for small inputs. rows: (doc_id, text), text may be None."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ids_of(name, texts):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def codec(rows):
    t, ids = ids_of("byte_bpe_50k.json", [x for _, x in rows])
    return sorted((k, len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for (k, _), i in zip(rows, ids))


def sstable(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    _, ids = ids_of("word_bpe_49k.json", [x for _, x in rows])
    out, start = [], 0
    for (k, _), i in zip(rows, ids):
        i = [*i, 1]
        out.append((k, start, len(i), crc(i)))
        start += len(i)
    return out


def check_packing(rows, pieces, capacity=1024):
    """rows have different ids; pieces: (doc_id, start, length, crc, doc_tokens, sequence, offset)."""
    _, ids = ids_of("byte_bpe_50k.json", [x for _, x in rows])
    ids = {k: [*i, 0] for (k, _), i in zip(rows, ids)}
    at = defaultdict(list)
    used = defaultdict(list)
    for k, start, n, c, total, seq, offset in pieces:
        assert total == len(ids[k]) and n > 0 and c == crc(ids[k][start : start + n])
        at[k].append((start, n))
        used[seq].append((offset, n))
    for parts in [*used.values(), *at.values()]:
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
    assert all(sum(n for _, n in v) == len(ids[k]) for k, v in ((k, at[k]) for k in ids))
    assert all(sum(n for _, n in v) <= capacity for v in used.values())
    return len(used), sum(map(len, ids.values()))


def warc(rows):
    """rows: (page_id, html)."""
    last = {}
    for k, h in rows:
        h = h or ""
        last[h] = max(k, last.get(h, k))
    out = []
    for k, h in rows:
        b = (h or "").encode()
        r = last[h or ""]
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if r == k else "revisit", None if r == k else r))
    return sorted(out)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(rows):
    sets = {k: shingles(t) for k, t in rows}
    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    common = Counter((a, b) for ks in by.values() for a in ks for b in ks if a < b)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    c = components(sets, links)
    return sorted((k, len(sets[k]), c[k], c[k] == k) for k in sets)


def suffix(rows, length=100):
    seen, out = set(), []
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def base(rows):
    out = []
    for k, t in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return sorted(out)


def em(patterns, iterations, start, prior_share, prior_good, prior_bad):
    """patterns: {votes: number}; [share, accuracies on good ones, accuracies on bad ones] by plain expectation-maximisation."""
    m = len(next(iter(patterns)))
    share, good, bad = start[0], [start[1]] * m, [start[2]] * m
    for _ in range(iterations):
        g = {p: posterior(p, share, good, bad) for p in patterns}
        share = (sum(n * g[p] for p, n in patterns.items()) + prior_share[0]) / (sum(patterns.values()) + sum(prior_share))
        good = [(sum(n * g[p] for p, n in patterns.items() if p[j] == 1) + prior_good[0]) / (sum(n * g[p] for p, n in patterns.items() if p[j]) + sum(prior_good)) for j in range(m)]
        bad = [(sum(n * (1 - g[p]) for p, n in patterns.items() if p[j] == -1) + prior_bad[0]) / (sum(n * (1 - g[p]) for p, n in patterns.items() if p[j]) + sum(prior_bad)) for j in range(m)]
    return [share, *good, *bad]


def posterior(votes, share, good, bad):
    a, b = share, 1 - share
    for v, x, y in zip(votes, good, bad):
        a *= x if v == 1 else 1 - x if v == -1 else 1
        b *= 1 - y if v == 1 else y if v == -1 else 1
    return a / (a + b)


def lines(rows, least=10):
    first, docs = {}, defaultdict(set)
    key = lambda x: lower(x.strip(STRIP))
    for k, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(k)
            first[key(x)] = min(k, first.get(key(x), k))
    out = []
    for k, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least or len(docs[key(x)]) < 2 or first[key(x)] == k]
        out.append((k, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)
