"""Exact byte-pair encoding from a tokenizer file, with a memory-mapped lexicon of frequent pieces.

``Codec`` gives the ids that the tokenizers library gives for a file (special tokens inside the text included).
A text is cut into pieces that no token can cross (white space decides); a piece's ids come from, in order, a
bounded per-process memo, the lexicon (``Lexicon``: a minimal acyclic transducer, memory-mapped), and an exact
merge. Texts with code points on which Unicode versions disagree go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

#: Pieces that a process remembers at most; then it starts afresh. Bounds memory, changes no result.
MEMO_PIECES = 250_000
#: Pieces that are looked up together.
PIECES_AT_ONCE = 500_000
#: White space other than the blank and the line feed, and the separators that str.split() cuts at but a tokenizer does not.
_RARE = "\t\x0b\x0c\r\x01\x1c\x1d\x1e\x1f\x85\xa0                　"
_UNSURE = regex.compile(r"[\p{Cn}]")
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _unsure(text: str) -> bool:
    """Whether the text holds code points that this Python doesn't know (the tokenizers library may know them)."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _UNSURE.search(text) is not None or any(unicodedata.category(c) == "Cn" for c in set(text))


class Lexicon:
    """A minimal acyclic transducer from byte strings to id lists, read in place from a file.

    Layout: magic, counts, then per node its first edge, per edge its label, its target and the number of
    accepted strings that sort before it (their sum along a path is the string's rank), per node whether it
    accepts; per rank the range of its ids. Equal suffixes share nodes.
    """

    MAGIC = b"QLEX0001"

    @staticmethod
    def build(path: str, entries: Iterable[tuple[bytes, list[int]]]) -> None:
        words = sorted(dict(entries).items())
        register: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        stack: list[list] = [[False, []]]  # along the last word: accepts, edges that are final

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        last = b""
        for word, _ in words:
            common = len(os.path.commonprefix([last, word]))
            while len(stack) - 1 > common:
                node = stack.pop()
                stack[-1][1].append((last[len(stack) - 1], freeze(node)))
            for _b in word[common:]:
                stack.append([False, []])
            stack[-1][0] = True
            last = word
        while len(stack) > 1:
            node = stack.pop()
            stack[-1][1].append((last[len(stack) - 1], freeze(node)))
        root = freeze(stack[0])
        count: list[int] = []
        first, labels, targets, before = [], bytearray(), [], []
        for accepts, edges in nodes:  # children come before their parents
            n = int(accepts)
            first.append(len(labels))
            for label, target in edges:
                labels.append(label)
                targets.append(target)
                before.append(n)
                n += count[target]
            count.append(n)
        first.append(len(labels))
        starts, flat = [0], []
        for _, ids in words:
            flat.extend(ids)
            starts.append(len(flat))
        head = Lexicon.MAGIC + struct.pack("<6I", len(nodes), len(labels), len(words), len(flat), root, 0)
        pad = -len(labels) % 4
        accept = bytes(int(a) for a, _ in nodes)
        body = b"".join([
            struct.pack(f"<{len(first)}I", *first), struct.pack(f"<{len(targets)}I", *targets), struct.pack(f"<{len(before)}I", *before),
            struct.pack(f"<{len(starts)}I", *starts), struct.pack(f"<{len(flat)}I", *flat), bytes(labels), b"\0" * pad, accept,
        ])
        with open(f"{path}.part", "wb") as f:
            f.write(head + body)
        os.replace(f"{path}.part", path)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        if bytes(view[:8]) != self.MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        n, e, w, k, self._root, _ = struct.unpack("<6I", view[8:32])
        at = 32

        def take(items: int) -> memoryview:
            nonlocal at
            part, at = view[at : at + 4 * items].cast("I"), at + 4 * items
            return part

        self._first, self._target, self._before, self._starts, self._ids = take(n + 1), take(e), take(e), take(w + 1), take(k)
        self._labels = at
        self._accept = view[at + e + (-e % 4) :]
        self.n_nodes, self.n_edges, self.n_words = n, e, w

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None if the lexicon lacks it."""
        node, rank, base, first, find = self._root, 0, self._labels, self._first, self._map.find
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[node], base + first[node + 1])
            if at < 0:
                return None
            rank += self._before[at - base]
            node = self._target[at - base]
        if not self._accept[node]:
            return None
        return bytes(self._ids[self._starts[rank] : self._starts[rank + 1]])


    @cached_property
    def _edges(self) -> tuple[np.ndarray, ...]:
        """Edges as numbers (node, label) in order, with their targets, words before them, accepting nodes, and the words' ids."""
        first, target, before, starts, ids = (np.frombuffer(x, "<u4").astype(np.int64) for x in (self._first, self._target, self._before, self._starts, self._ids))
        labels = np.frombuffer(self._map, np.uint8, self.n_edges, self._labels)
        return np.repeat(np.arange(self.n_nodes) << 8, np.diff(first)) + labels, target, before, np.frombuffer(self._accept, np.uint8)[: self.n_nodes] > 0, starts, ids

    def ranks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The places of many words (bytes from offset to offset) among the lexicon's, -1 for others: all walk the automaton together."""
        keys, target, before, accept, _, _ = self._edges
        size = np.diff(offsets)
        node, rank, out = np.full(len(size), self._root), np.zeros(len(size), np.int64), np.full(len(size), -1)
        left, at = np.arange(len(size)), 0
        while len(left):
            done = left[size[left] == at]
            done = done[accept[node[done]]]
            out[done] = rank[done]
            left = left[size[left] > at]
            key = (node[left] << 8) + data[offsets[left] + at]
            edge = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            ok = keys[edge] == key if len(keys) else np.zeros(len(left), bool)
            left, edge = left[ok], edge[ok]
            rank[left] += before[edge]
            node[left] = target[edge]
            at += 1
        return out


class _Memo(dict):
    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = self.codec.lexicon.get(piece.encode()) if self.codec.lexicon else None
        self[piece] = ids = self.codec.merge(piece) if ids is None else ids
        return ids


class Codec:
    """Encodes whole texts to ids (as bytes: little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, path: str, lexicon: str | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        letters = _byte_letters()
        self._suffix = model.get("end_of_word_suffix") or ""
        self._byte_level = not self._suffix
        pre = json.dumps(spec["pre_tokenizer"])
        plain = not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and spec["post_processor"] is None
        if model["type"] != "BPE" or "ByteLevel" not in pre or not plain:
            raise ValueError(f"{path}: only byte-level BPE files are read")
        mark = b"\xff" if self._suffix else b""  # no UTF-8 text holds this byte, so it can stand for the end of a word

        def raw(token: str) -> bytes:
            if self._suffix and token.endswith(self._suffix):
                return bytes(letters[c] for c in token.removesuffix(self._suffix)) + mark
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special}
        self._mark = mark
        ranks = {b: i for i, b in self.tokens.items()}
        if mark:
            # In such files byte 0xFF alone stands for an unused letter; its id moves out of the way of the mark.
            ranks[mark] = max(self.tokens) + len(self.special) + 1
        self._bpe = tiktoken.Encoding("pieces", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        whole = tiktoken.Encoding("texts", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._texts = whole._core_bpe if self._byte_level else None
        self._cut = regex.compile(_BYTE_PATTERN if self._byte_level else _WORD_PATTERN)
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self._memo = _Memo(self)
        self._library: Tokenizer | None = None

    def merge(self, piece: str) -> bytes:
        """Exact merges of one piece, without any table of words."""
        if self._texts:
            return bytes(self._texts.encode_to_tiktoken_buffer(piece, set()))
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece, mark, one = piece.lower(), self._mark, self._bpe.encode_single_piece
        ids = one(piece.encode() + mark) if piece.isalpha() else [i for w in self._cut.findall(piece) for i in one(w.encode() + mark)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> list[str]:
        """Cut a text (without special tokens) where no token can cross."""
        rare = any(c in text for c in _RARE)
        if not self._byte_level:
            return text.split() if not rare else [text]
        if rare or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
            return self._cut.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def _plain(self, text: str) -> bytes:
        """A text without special tokens. Without a lexicon a byte-level text goes through the merges in one call."""
        if self._texts and not self.lexicon:
            return bytes(self._texts.encode_to_tiktoken_buffer(text, set()))
        return b"".join(map(self._memo.__getitem__, self.pieces(text)))

    def parts(self, text: str) -> list[str]:
        """The pieces that ``encode`` looks up; for counting what is frequent."""
        if _unsure(text):
            return []
        return [p for s in (self._specials.split(text) if self._specials else [text]) if s for p in self.pieces(s)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _unsure(text):
            self._library = self._library or _library(self.path)
            ids = self._library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self._specials is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            if m.start() > at:
                out.append(self._plain(text[at : m.start()]))
            out.append(struct.pack("<I", self.special[m.group()]))
            at = m.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. With a lexicon the pieces of many texts are looked up together, each different one once."""
        plan, pieces = [], []
        for t in texts:
            if not t or self.lexicon is None or _unsure(t) or (self._specials is not None and "<|" in t):
                plan.append(np.frombuffer(self.encode(t), "<u4"))
            else:
                own = self.pieces(t)
                pieces += own
                plan.append(len(own))
            if len(pieces) >= PIECES_AT_ONCE:
                yield from self._looked_up(plan, pieces)
                plan, pieces = [], []
        yield from self._looked_up(plan, pieces)

    def _looked_up(self, plan: list[int | np.ndarray], pieces: list[str]) -> Iterator[np.ndarray]:
        """plan: per text its ids, or how many of the pieces are its own."""
        if pieces:
            d = pa.array(pieces, pa.string()).dictionary_encode()
            at, words = d.indices.to_numpy(), d.dictionary
            _, offsets, data = words.buffers()
            offsets, data = np.frombuffer(offsets, np.int32, len(words) + 1).astype(np.int64), np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8)
            rank = self.lexicon.ranks(data, offsets)
            _, _, _, _, starts, known = self.lexicon._edges
            # Ids of the lexicon's words, then of the others, which are merged.
            other = np.flatnonzero(rank < 0)
            merged = [self.merge(p) for p in words.take(pa.array(other)).to_pylist()]
            flat = np.concatenate([known, np.frombuffer(b"".join(merged), "<u4")])
            size, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            inside = rank >= 0
            size[inside], first[inside] = starts[rank[inside] + 1] - starts[rank[inside]], starts[rank[inside]]
            size[other] = [len(m) // 4 for m in merged]
            first[other] = len(known) + np.cumsum(size[other]) - size[other]
            n = size[at]
            ends = np.cumsum(n)
            ids = flat[np.arange(int(n.sum())) + np.repeat(first[at] - (ends - n), n)].astype("<u4")
        used = begin = 0
        for x in plan:
            if isinstance(x, np.ndarray):
                yield x
                continue
            used += x
            end = int(ends[used - 1]) if used else 0
            yield ids[begin:end]
            begin = end

    def byte_table(self) -> list[bytes]:
        """Bytes by id, for byte-level files, special tokens as their text."""
        size = max([*self.tokens, *self.special.values()]) + 1
        table = [b""] * size
        for i, b in self.tokens.items():
            table[i] = b
        for s, i in self.special.items():
            table[i] = s.encode()
        return table

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids of a byte-level file, bytes that are not UTF-8 replaced."""
        return b"".join(map(_table(self).__getitem__, ids)).decode("utf-8", "replace")


def _table(codec: Codec) -> list[bytes]:
    if not hasattr(codec, "_bytes"):
        codec._bytes = codec.byte_table()
    return codec._bytes


def _library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=8)
def codec(path: str, lexicon: str | None = None) -> Codec:
    """One codec per process and file; a lexicon's path is new for each build."""
    return Codec(path, lexicon)
