"""Toxicity after noisy-channel deobfuscation.

1. A character language model: trigram counts over all texts (a bounded alphabet of 64 classes, partial counts per task),
   mixed with that of the learnt words.
2. Tokens that look disguised (leetspeak inside a word, a letter three times in a row, single letters in a row) become a
   lattice of characters: a sign may be the letter it imitates or stay a break, a repeated letter or a
   separator may vanish. Viterbi decoding takes the path of least cost under channel and language model. Other tokens
   have one path, themselves.
3. From labelled documents (at most ``LABELLED``, chosen by a hash of their ids) words and their prefixes of 4 to 6 letters
   that toxic documents hold far more often (log-likelihood ratio of at least ``LEAST_LLR``: by chance one in some
   ten million words would pass; at most ``LEXICON`` of them, those of the greatest difference in rate) get weights; a
   logistic regression over a document's strongest weight, number and rate of hits, fitted on other labelled
   documents than the words, gives the score.

Only texts make a score; labels serve fitting alone, and never those of rows whose crc32(doc_id) mod 4 is 2.
Null and empty texts score as texts without hits; repeated rows score equally; without labels of both kinds every
text gets the smoothed base rate. A null id counts as an empty one for the remainder and stays null. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, tidy

LABELLED = 20_000
LEXICON = 4096
LEAST_LLR = 28.0
PREDICT_AT = 0.3
#: Characters decoded between looks at what all paths agree on.
SETTLE = 64
#: Tokens a process remembers at most.
MEMO_TOKENS = 300_000

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáàâãçéèêëíìîïñóòôõúùûœæåø"
CLASSES = 64
_CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.full(0x182, CLASSES - 1, np.int32)
for _x in range(0x181):
    _TABLE[_x] = _CLASS.get(chr(_x), CLASSES - 1 if chr(_x).isalpha() else 0)
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "ı": "i", "*": "uio"}
SEPARATORS = " .-_*,~'"
#: Costs in nats: reading a sign as a letter, keeping it as a break, dropping a repeated letter or a separator.
LEET_COST, BREAK_COST, REPEAT_COST, SEPARATOR_COST = 0.7, 4.0, 1.0, 0.3
_EDGE_R = ".,;:!?\"'()[]{}|#%&*$~<>/\\=+-_"
_EDGE_L = "\"'([{|#%&*~<>/\\=-_.,;:?"
_LEETED = re.compile(r"[^\W\d_][0-9@$!|+€(£*]+[^\W\d_]|^[0-9@$!€£]+[^\W\d_]|[^\W\d_][0-9@$]+$")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOTTED = re.compile(r"^[^\W_](?:[.\-_*~'][^\W_]){2,}$")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 4 == 2


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        for text in b.column(0):
            t = text.as_py()
            for at in range(0, len(t or ""), 1 << 20):
                x = np.frombuffer(t[at : at + (1 << 20)].lower().encode("utf-32-le"), "<u4")
                c = np.concatenate(([0, 0], _TABLE[np.minimum(x, 0x181)], [0]))
                # A word's first letter follows two breaks: what lies before a break doesn't matter.
                before = np.where(c[1:-1] == 0, 0, c[:-2])
                total += np.bincount((before * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])


def character_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of all texts; at most CLASSES^3 rows reach the driver."""
    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3)
    out[[r.code for r in rows]] = [r.n for r in rows]
    return out.reshape(CLASSES, CLASSES, CLASSES)


def word_counts(words: list[str]) -> np.ndarray:
    out = np.zeros((CLASSES,) * 3)
    for w in words:
        c = [0, 0, *(_CLASS.get(x, CLASSES - 1) for x in w), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            out[a, b, d] += 1
    return out


def model(counts: np.ndarray) -> np.ndarray:
    """Probabilities of a character after two others, interpolated with shorter contexts."""
    uni = (counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * CLASSES)
    two = counts.sum(0)
    bi = (two + 8 * uni) / (two.sum(1, keepdims=True) + 8)
    return (counts + 8 * bi[None]) / (counts.sum(2, keepdims=True) + 8)


class Restorer:
    """Viterbi decoding of disguised tokens. costs: negative log probabilities."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs

    def restore(self, observed: str) -> str:
        """The likeliest text; breaks are blanks."""
        costs = self.costs
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        last, settled = "", []
        for at, ch in enumerate(observed):
            if at % SETTLE == 0 and at:
                # What all paths begin with is decided, so that texts of any length take linear time.
                n = len(os.path.commonprefix([text for _, text in best.values()]))
                settled.append(next(iter(best.values()))[1][:n])
                best = {key: (cost, text[n:]) for key, (cost, text) in best.items()}
            options: list[tuple[str, float]] = []
            if ch in _CLASS or ch.isalpha():
                options.append((ch, 0.0))
            else:
                options.append((" ", 0.0 if ch == " " else BREAK_COST))
            options += [(x, LEET_COST) for x in LEET.get(ch, "")]
            if ch in SEPARATORS:
                options.append(("", SEPARATOR_COST))
            elif ch == last or LEET.get(ch, "~")[0] == last:
                options.append(("", REPEAT_COST))
            last = ch
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in best.items():
                for emit, price in options:
                    if not emit:
                        key, new = (a, b), (cost + price, text)
                    else:
                        e = _CLASS.get(emit, 0 if emit == " " else CLASSES - 1)
                        key, new = ((0, 0) if e == 0 else (b, e)), (cost + price + costs[0 if b == 0 else a, b, e], text + emit)
                    if key not in step or new < step[key]:
                        step[key] = new
            best = step
        _, text = min((cost + costs[0 if b == 0 else a, b, 0], text) for (a, b), (cost, text) in best.items())
        return "".join([*settled, text])

    def spelled(self, tokens: list[str]) -> list[str]:
        """The words that runs of single characters spell."""
        return [w for run in spaced(tokens) for w in re.split(r"\s+", self.restore(run)) if w]

    def words(self, token: str) -> list[str]:
        """The words of a lower-case token, restored if it looks disguised."""
        w = token.rstrip(_EDGE_R).lstrip(_EDGE_L)
        if not w:
            return []
        if not w.isalpha() and (_LEETED.search(w) or _DOTTED.search(w)) or _TRIPLE.search(w):
            w = self.restore(w)
        if w.isalpha():
            return [w]
        return [x for x in re.split(r"[^\w]+|\d+|_+", w) if x]


def spaced(tokens: list[str]) -> list[str]:
    """Runs of at least three single characters, each joined with blanks."""
    out, run = [], []
    for t in [*tokens, ""]:
        x = t.strip(_EDGE_R) or t
        if len(x) == 1 and (x.isalpha() or x in LEET):
            run.append(x)
        else:
            if len(run) >= 3:
                out.append(" ".join(run))
            run = []
    return out


def _features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


def _document_words(r: Restorer, text: str | None) -> tuple[list[str], int]:
    """All words of a text, restored, and the number of tokens."""
    tokens = (text or "").lower().split()
    words = [w for t in tokens for w in r.words(t)]
    return words + r.spelled(tokens), len(tokens)


class Scorer:
    """weights: by feature; coefficients of the regression (None: a constant)."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], beta: list[float] | None, base: float) -> None:
        self.restorer, self.weights, self.beta, self.base = Restorer(costs), weights, beta, base
        self._memo: dict[str, float] = {}

    def weight(self, words: list[str]) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in words for f in _features(w)), default=0.0)

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """Strongest weight, hits, and words per hit's rate."""
        tokens = (text or "").lower().split()
        memo, hits = self._memo, []
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        single = 0
        for t in tokens:
            w = memo.get(t)
            if w is None:
                w = memo[t] = self.weight(self.restorer.words(t)) if len(t.strip(_EDGE_R) or t) > 1 else -1.0
            if w:
                if w > 0:
                    hits.append(w)
                else:
                    single += 1
        if single >= 3:
            hits += [w for w in (self.weight([x]) for x in self.restorer.spelled(tokens)) if w > 0]
        return max(hits, default=0.0), float(len(hits)), 100.0 * len(hits) / max(1, len(tokens))

    def score(self, text: str | None) -> float:
        if self.beta is None:
            return self.base
        z = float(np.dot(self.beta, design(*self.measure(text))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def design(strongest: float, hits: float, rate: float) -> list[float]:
    return [1.0, float(hits > 0), strongest / 4.0, math.log1p(hits), math.log1p(rate)]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method, all but the constant penalised."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return beta.tolist()


def _llr(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log-likelihood ratio of a word being in toxic and other documents at different rates."""
    part = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / n), 0) + np.where(n - k > 0, (n - k) * np.log(np.maximum(n - k, 1e-12) / n), 0)
    return 2 * (part(pos, n_pos) + part(neg, n_neg) - part(pos + neg, n_pos + n_neg))


@tidy
def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from the labelled rows that may be learnt from, and the language model of all texts."""
    spark = df.sparkSession
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    picked = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    picked = materialize(picked, "labelled")
    costs = -np.log(model(character_counts(df, text_col)))
    # At most LABELLED ids are broadcast; texts of the labelled documents stay on the executors.
    sample = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    sample = materialize(sample.withColumn("fold", F.crc32(F.col("id").cast("string")) % 4 == 3).repartition(max(2, spark.sparkContext.defaultParallelism)), "labelled-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, pos, neg = Restorer(costs), Counter(), Counter()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1)):
                words, _ = _document_words(r, text.as_py())
                (pos if y else neg).update({f for w in set(words) for f in _features(w)})
        keys = list(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["f", "pos", "neg"])

    totals = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    n_pos, n_neg = totals.get((False, 1), 0), totals.get((False, 0), 0)
    base = (sum(n for (_, y), n in totals.items() if y == 1) + 0.5) / (sum(totals.values()) + 5)
    if not n_pos or not n_neg:
        return Scorer(costs, {}, None, base)
    rate = F.col("pos") / n_pos > 4 * F.col("neg") / n_neg
    found = (
        sample.filter("not fold").select("y", "text").mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter((F.col("pos") >= 4) & rate).orderBy(F.desc(F.col("pos") / n_pos - F.col("neg") / n_neg), "f").limit(LEXICON).collect()
    )
    pos, neg = np.array([r.pos for r in found], float), np.array([r.neg for r in found], float)
    llr = _llr(pos, neg, n_pos, n_neg)
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    weights = {r.f: float(o) for r, o, s in zip(found, odds, llr) if s >= LEAST_LLR}
    if not weights:
        return Scorer(costs, {}, None, base)
    learnt = -np.log(0.8 * np.exp(-costs) + 0.2 * model(word_counts([f for f in weights if f[0] != "^"])))
    half = Scorer(learnt, weights, None, base)

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [half.measure(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*x))], ["y", "a", "b", "c"])

    rows = sample.filter("fold").select("y", "text").mapInArrow(measures, "y int, a double, b double, c double").collect()  # at most LABELLED
    if len({r.y for r in rows}) < 2:
        return Scorer(learnt, weights, None, base)
    beta = fit(np.array([design(r.a, r.b, r.c) for r in rows]), np.array([r.y for r in rows], float))
    return Scorer(learnt, weights, beta, base)


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = df.sparkSession.sparkContext.broadcast((scorer.restorer.costs, scorer.weights, scorer.beta, scorer.base))  # CLASSES^3 numbers, LEXICON words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.score(t.as_py()) for t in b.column(2)], pa.float64())], ["doc_id", "held_out", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
