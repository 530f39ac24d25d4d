"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums, over all strings of ``ORDER`` letters, the
product of their weights in either word, where an occurrence that spans s
letters with its gaps weighs ``DECAY ** s`` (up to ``SPAN`` letters); it is
normalised to 1 for a word with itself.  A mark before the first letter counts
as a letter.  So an inserted letter or a gap lowers the kernel but keeps it.  Words are
folded first: lower case, without accents, look-alike digits read as letters,
everything else dropped (so "i.d.i.o.t" is a word), and runs of single
letters are joined.

Training sentences come from labelled documents: every sentence of a clean
document is negative; of a toxic document the best-scoring sentence is the
positive one (chosen anew in each round), and a sentence scores as its best
word.  Landmarks are the words most tied to toxic documents and frequent
words of clean ones.  A linear SVM on the Nystroem features of the witness
words is again an expansion over the landmarks, hence one weight per string:
scoring a word is a sum over its gapped strings.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import settled, whole

ORDER, SPAN, DECAY = 4, 8, 0.6
LETTERS = 27  # the mark (0) and a to z
FEATURES = LETTERS ** ORDER
LONGEST = 16  # letters of a word looked at together; longer words are read in overlapping parts
CACHE = 1 << 18  # words in one generation of a worker's cache
TOGETHER = 1 << 23  # characters of the texts that are cut into words together

#: Digits and signs read as the letters they look like.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _fold_table() -> dict[int, str]:
    """Lower-case base letter of every Latin letter up to U+024F."""
    out = {ord(k): v for k, v in LOOKALIKE.items()} | {ord("ß"): "s"}
    for c in range(65, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= base <= "z":
            out[c] = base
    return out


_FOLD = _fold_table()
_SINGLES = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


def joined(text: str) -> str:
    """The text with runs of four or more single characters written together."""
    return _SINGLES.sub(lambda m: m.group().replace(" ", ""), text)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): the folded letters (1 to 26) of all words in a row, and how many each has."""
    text = "\n".join(words).translate(_FOLD) + "\n"
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    letter = (raw >= 97) & (raw <= 122)
    word = np.cumsum(raw == 10)
    # the newline ends its word: letters before the k-th newline belong to word k
    return raw[letter] - 96, np.bincount(word[letter], minlength=len(words) + 1)[:len(words)]


def parts(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words cut to at most ``LONGEST`` letters: (word of each part, per
    length 3.. the part numbers, per length the code matrix).  The first part
    of a word starts with the mark, as do all of short words."""
    codes, n = letters(words)
    start = np.cumsum(n) - n
    step = LONGEST // 2
    pieces = np.where(n > LONGEST, -(-(n - LONGEST) // step) + 1, 1)
    word = np.repeat(np.arange(len(words)), pieces)
    k = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = start[word] + k * step
    size = np.minimum(n[word] - k * step, LONGEST)
    by_size = [np.flatnonzero(size == m) for m in range(ORDER - 1, LONGEST + 1)]
    return word, by_size, [np.concatenate([np.zeros((len(p), 1), codes.dtype), codes[at[p][:, None] + np.arange(m)]], 1)
                           for m, p in enumerate(by_size, ORDER - 1)]


def _occurrences(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings in m letters that span at most ``SPAN``, and their weights."""
    at = [c for c in combinations(range(m), ORDER) if c[-1] - c[0] < SPAN]
    return np.array(at), np.array([DECAY ** (c[-1] - c[0] + 1) for c in at], np.float32)


_AT = {m: _occurrences(m) for m in range(ORDER, LONGEST + 2)}


def strings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers [word, occurrence], weights [occurrence]) of words of one length."""
    at, weight = _AT[codes.shape[1]]
    out = codes[:, at[:, 0]].astype(np.int32)
    for k in range(1, ORDER):
        out = out * LETTERS + codes[:, at[:, k]]
    return out, weight


def norms(idx: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself: equal strings of a word
    add up before they are squared."""
    order = np.argsort(idx, axis=1)
    ranked = np.take_along_axis(idx, order, 1)
    new = np.ones(idx.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight[order].ravel(), first)
    return np.sqrt(np.bincount(first // idx.shape[1], weights=total * total, minlength=len(idx)))


def features(words: list[str], weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernel products [word, column] of the words with the columns
    of ``weights``, whose row of a feature is ``rows[feature]`` (the feature
    itself if not given); of a long word the part with the greatest first
    product; words of fewer than three letters give 0."""
    word, by_size, codes = parts(words)
    part = np.zeros((len(word), weights.shape[1]), np.float32)
    for p, c in zip(by_size, codes):
        for at in range(0, len(p), 2048):
            idx, w = strings(c[at:at + 2048])
            size = norms(idx, w)
            if rows is not None:
                idx = rows[idx]
            got = (weights[:, 0][idx] @ w)[:, None] if weights.shape[1] == 1 else np.stack([w @ weights[r] for r in idx])
            part[p[at:at + 2048]] = got / size[:, None]
    if len(word) == len(words):
        return part
    best = np.lexsort((part[:, 0], word))
    return part[best[np.flatnonzero(np.diff(np.append(word[best], -1)))]]


def vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights of the strings of the words: (compact matrix
    [string, word] whose row 0 is empty, row of every feature)."""
    _, by_size, codes = parts([w[:LONGEST] for w in words])
    found = [(number, *strings(c[i:i + 1])) for p, c in zip(by_size, codes) for i, number in enumerate(p.tolist())]
    rows = np.zeros(FEATURES, np.int32)
    used = np.unique(np.concatenate([idx.ravel() for _, idx, _ in found])) if found else np.zeros(0, np.int64)
    rows[used] = np.arange(1, len(used) + 1)
    out = np.zeros((len(used) + 1, len(words)), np.float32)
    for number, idx, w in found:
        np.add.at(out[:, number], rows[idx[0]], w)
    size = np.sqrt((out ** 2).sum(0, keepdims=True))
    return out / np.where(size > 0, size, 1), rows


@dataclass
class Model:
    """score(text) = logistic(slope * best word's margin + offset)."""

    weights: np.ndarray  # [feature, 1]
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        return features(words, self.weights)[:, 0] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))


# --- training -------------------------------------------------------------------

def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM (bias last, hardly penalised) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], penalty)
    reg[-1] = 1e-4

    def loss(v: np.ndarray) -> float:
        return float((reg * v * v).sum() + (cost * np.maximum(1 - y * (x @ v), 0) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * cost[on, None]
        step = np.linalg.solve(a.T @ x[on] + np.diag(reg), reg * w - a.T @ (y[on] * slack[on]))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * before:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic curve that crosses 0.5 where fewest
    training documents fall on the wrong side (in the middle of that gap);
    the slope is the likeliest one, by bisection of the log-likelihood's
    derivative."""
    order = np.argsort(margin, kind="stable")
    m, up = margin[order], y[order] > 0
    wrong = np.concatenate([[0], np.cumsum(up)]) + np.concatenate([np.cumsum((~up)[::-1])[::-1], [0]])
    wrong[1:-1][m[1:] == m[:-1]] = len(m) + 1  # equal margins stay together
    k = int(np.argmin(wrong))
    low, high = m[k - 1] if k else m[0] - 2, m[k] if k < len(m) else m[-1] + 2
    z = margin - (low + high) / 2
    t = np.where(y > 0, 1 - 1 / (up.sum() + 2), 1 / ((~up).sum() + 2))
    lo, hi = 0.05, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = 1 / (1 + np.exp(-np.clip(mid * z, -30, 30)))
        lo, hi = (mid, hi) if (z * (t - p)).sum() > 0 else (lo, mid)
    return lo, -lo * (low + high) / 2


def _landmarks(words: list[str], n: int, alike: float = 0.7) -> list[str]:
    """The first n of the words that are not too much like one taken before."""
    out, maps = [], []
    for w in words:
        own = _weights(w)
        if len(out) < n and own and all(sum(v * m.get(k, 0.0) for k, v in own.items()) < alike for m in maps):
            out.append(w)
            maps.append(own)
    return out


def _weights(word: str) -> dict[int, float]:
    """The word's strings and their normalised weights."""
    matrix, rows = vectors([word])
    used = np.flatnonzero(rows)
    return dict(zip(used.tolist(), matrix[rows[used], 0].tolist()))


def train(documents: list[tuple[list[list[str]], int]], landmarks: int = 192, rounds: int = 5, negatives: int = 6000) -> Model:
    """``documents``: (sentences as lists of words, label).  Without both
    labels the model gives 0.5 or the only label's side."""
    if not documents or len({y for _, y in documents}) < 2:
        only = documents[0][1] if documents else None
        return Model(np.zeros((FEATURES, 1), np.float32), 0.0, 1.0, 0.0 if only is None else 3.0 if only else -3.0)
    words = sorted({w for s, _ in documents for ws in s for w in ws})
    number = {w: i for i, w in enumerate(words)}
    bags = [([np.unique([number[w] for w in ws]) for ws in s if ws], y) for s, y in documents]
    bags = [b for b in bags if b[0]]
    # sentences that hold a word, by label; copies of documents count their sentences once
    df, n, seen = np.zeros((2, len(words))), np.ones(2), set()
    for s, y in bags:
        for b in s:
            if (key := (y, b.tobytes())) not in seen:
                seen.add(key)
                df[y, b] += 1
                n[y] += 1
    # how much more often in toxic documents' sentences, in standard deviations
    rate = (df.sum(0) + 0.5) / (n.sum() + 1)
    tie = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    order = np.argsort(-tie, kind="stable")
    clean = np.argsort(-df[0], kind="stable")
    marks, rows = vectors(_landmarks([words[i] for i in order[:8 * landmarks]], landmarks * 2 // 3)
                          + [words[c] for c in clean if tie[c] < 2][:landmarks // 3])
    gram = marks.T @ marks
    value, vector = np.linalg.eigh(gram.astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    # words of toxic documents only, too often for chance among so many words
    marked = set(np.flatnonzero((df[0] == 0) & (df[1] * np.log(n.sum() / n[1]) > np.log(20 * len(words)))).tolist())
    margin = tie.copy()  # the first witnesses are the words most tied to the label
    rng = np.random.default_rng(1)
    model, against = None, {int(i): 1 for i in [*clean[:2000], *rng.choice(len(words), min(len(words), negatives), replace=False)]
                            if df[0, i] > 0}
    for _ in range(rounds):
        good, bad = Counter(), Counter()
        for s, y in bags:
            best = [int(b[np.argmax(margin[b])]) for b in s]
            if y:
                good[max(best, key=lambda i: margin[i])] += 1
            else:
                bad.update(best)
        for i in bad:  # a word of clean sentences is no witness
            good.pop(i, None)
        sure = sorted(set(good) | marked)
        # negatives stay for later rounds: frequent clean words, random ones, and the hardest so far
        for i in sorted(bad, key=lambda i: -margin[i])[:negatives]:
            against[i] = max(against.get(i, 0), bad[i])
        chosen = sorted(set(against) - set(sure))
        # witnesses with an inserted letter, at every place, count as well
        twisted = [w[:k] + chr(rng.integers(97, 123)) + w[k:] for i in sure for w in [words[i]] if len(w) > 3
                   for k in range(1, len(w))]
        train_words = [words[i] for i in sure] + twisted + [words[i] for i in chosen]
        y = np.array([1.0] * (len(sure) + len(twisted)) + [-1.0] * len(chosen))
        cost = np.ones(len(y))
        # a clean word counts by the sentences whose best word it was
        cost[len(sure) + len(twisted):] = [min(50, against[i]) for i in chosen]
        cost[:len(sure)] = max(1.0, len(chosen) / max(1, len(sure)) / 2)
        w = svm(features(train_words, marks, rows) @ root, y, cost)
        each = (marks @ (root @ w[:-1])).astype(np.float32)
        model = Model(each[rows][:, None], float(w[-1]), 1.0, 0.0)
        margin = model.margins(words)
    top = np.array([max(margin[b].max() for b in s) for s, _ in bags])
    slope, offset = calibrate(top, np.array([1 if y else -1 for _, y in bags]))
    model.slope, model.offset = float(slope), float(offset)
    return model


# --- Spark -----------------------------------------------------------------------

_SENTENCE = re.compile(r"[.!?\n]+\s")


def in_training(id_col: str, folds: int = 5) -> Column:
    """Training rows: crc32 of the id as text is no multiple of ``folds`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) != 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = 4000, sentences: int = 200, **train_args) -> Model:
    """The model, trained on a bounded sample of the labelled training rows:
    about ``sample_rows`` documents, half of either label as far as there are,
    chosen by a hash of their id, and up to ``sentences`` sentences of each."""
    marked = labels.filter(F.col(label).isNotNull() & in_training(id_col)) \
        .select(F.col(id_col).alias("id"), (F.col(label) != 0).cast("int").alias("y")).dropDuplicates(["id"])
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, sample_rows / 2 / max(1, n.get(1, 0))).otherwise(sample_rows / 2 / max(1, n.get(0, 0)))
    chosen = settled(marked.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003))
    if chosen.count() <= 4 * sample_rows:  # as good as always: its expected size is at most sample_rows
        chosen = F.broadcast(chosen)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole(text).alias("text")).join(chosen, "id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for body, y in zip(pdf["text"], pdf["y"]):
                found = [" ".join(dict.fromkeys(folded(s.split()))) for s in _SENTENCE.split(joined(body))[:sentences]]
                out.append(("\n".join(found), y))
            yield pd.DataFrame(out, columns=["s", "y"])

    got = sorted((r["s"], r["y"]) for r in rows.mapInPandas(cut, "s string, y int").collect())
    return train([([[sys.intern(w) for w in s.split()] for s in body.split("\n")], y) for body, y in got], **train_args)


def folded(words: list[str]) -> list[str]:
    """The words' folded letters; words of fewer than three letters go."""
    codes, n = letters(words)
    text = (codes + 96).astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(n).tolist()
    return [text[e - k:e] for e, k in zip(ends, n.tolist()) if k >= 3]


class Memory:
    """Margins of the words seen lately, in two generations."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def margins(self, words: list[str]) -> np.ndarray:
        young, old = self.young, self.old
        got = [young.get(w) or old.get(w) for w in words]
        new = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(new, self.model.margins([words[i] for i in new]).tolist()):
            got[i] = x
        if len(young) + len(words) > CACHE:
            self.old, self.young = young, {}
        self.young.update(zip(words, got))
        return np.array(got)


def best_margins(texts: list[str], memory: Memory) -> np.ndarray:
    """The greatest margin of a word in each text; the bias for texts without words."""
    out = np.full(len(texts), memory.model.bias, np.float64)
    at = 0
    while at < len(texts):
        chars, end = 0, at
        while end < len(texts) and (end == at or chars < TOGETHER):
            chars += len(texts[end])
            end += 1
        cut = pc.utf8_split_whitespace(pa.array([joined(t) for t in texts[at:end]], pa.large_string()))
        coded = cut.values.dictionary_encode()
        if len(coded):
            margin = memory.margins(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            bounds = cut.offsets.to_numpy()
            full = np.flatnonzero(np.diff(bounds))
            out[at + full] = np.maximum.reduceat(margin, bounds[full])
        at = end
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", **fit_args) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    ``score`` (0 to 1) depends on the text alone; ``predicted`` is 1 from 0.5
    on; ``held_out`` rows were not trained on.  Null and empty texts score as
    a text without any known word; repeated rows score alike; an empty table
    gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text, label, **fit_args))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Memory(model.value)
        for bodies in batches:
            yield pd.Series(model.value.probability(best_margins(bodies.tolist(), memory)))

    scored = docs.select(F.col(id_col), (~in_training(id_col)).alias("held_out"), probability(whole(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
