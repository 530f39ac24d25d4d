"""LM scoring: a causal self-attention model over subword ids, in numpy.

Text is read as its lower-cased (A-Z) words; a word is the subword ids of
" word" by the merge ranks of a public tokenizer, and every text ends with an
end id.  The model gives the next id as

    p(id) = p(class of id | context) * p(id | class, previous id)

The second factor and the prior of the first are smoothed bigram counts of
the whole training corpus; self-attention over the window corrects the
prior's logits.  So an untrained network scores like the bigram counts, and
both factors are normalised.  Ids outside the ``top`` most frequent ones are
one symbol, times the share of the id among them.

Scoring cuts a text into overlapping windows (``OVERLAP`` ids of context,
``STRIDE`` ids scored): every id is scored once, many windows are one batched
matrix product with a causal mask.

Beside it, the unigram score of the words: counts of frequent words (a list
of bounded length) are broadcast; all other words meet their counts in one
shuffle by word.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import held, release, settled, whole

STRIDE, OVERLAP = 24, 8
WIDTH = STRIDE + OVERLAP
CACHE = 1 << 17  # words in one generation of a worker's cache
ROWS = 1024  # rows that are texts in a worker at a time
IDS = 1 << 20  # ids that are read together


# --- subword ids -----------------------------------------------------------------

@dataclass
class Cut:
    """Texts as words: the distinct words, each place's word, and the places of each text."""

    words: list[str]
    at: np.ndarray
    bounds: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per distinct word."""
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return np.bincount(doc, weights=values[self.at], minlength=len(self.bounds) - 1)


def cut(texts: list[str]) -> Cut:
    """Words of the texts: A-Z lowered, cut at ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = parts.values.dictionary_encode()
    words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    if "" in words:  # before and after outer white space
        full = at != words.index("")
        at, doc = at[full], doc[full]
    return Cut(words, at, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]))


def portions(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def text_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The first column's texts, a few rows as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from portions(batch.column(0).slice(at, ROWS).to_pylist())


class Words:
    """Subword ids of words, repeated ones encoded once."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._engine = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._cuts = pattern == public_tokenizers.PATTERN
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._bytes = np.zeros(self.size, np.int64)
        self._bytes[list(ranks.values())] = [len(t) for t in ranks]
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _keep(self, w: str, ids: bytes) -> bytes:
        if len(self._young) >= CACHE:
            self._old, self._young = self._young, {}
        self._young[w] = ids
        return ids

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of the words; those not known are encoded in one call.  The
        public pattern starts a piece at a space that follows no white space,
        so only words that end in other white space are encoded apart."""
        out = list(map(self._young.get, words))
        before, new = self._old.get, []
        for i in [i for i, x in enumerate(out) if x is None]:
            got = before(words[i])
            if got is not None:
                out[i] = self._keep(words[i], got)
            elif self._cuts and words[i][-1:].strip():
                new.append(i)
            else:
                out[i] = self._keep(words[i], array("i", self._engine.encode_ordinary(" " + words[i])).tobytes())
        if new:
            ids = self._engine.encode_to_numpy("".join([" " + words[i] for i in new]), disallowed_special=()).astype(np.int32)
            size = pc.binary_length(pa.array([words[i] for i in new], pa.large_string())).to_numpy() + 1
            upto = (np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(size)) + 1).tolist()
            packed = ids.tobytes()
            for i, a, b in zip(new, [0, *upto], upto):
                out[i] = self._keep(words[i], packed[4 * a:4 * b])
        return out

    def ids(self, c: Cut) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each); every text ends with the end id."""
        ids = self._learned(c.words) + [array("i", [self.end]).tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        start = np.cumsum(size) - size
        at = np.insert(c.at, c.bounds[1:], len(c.words))
        n = size[at]
        ends = np.cumsum(n)
        flat = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)]
        return flat, np.concatenate([[0], ends[c.bounds[1:] + np.arange(len(c.bounds) - 1)]])


def words_of(path: str, pattern: str) -> Words:
    return held(("words", path, pattern), lambda: Words(path, pattern))


# --- the model ---------------------------------------------------------------------

@dataclass
class Tables:
    """What the counts give.  Symbols: the top ids by rank, then one for all others."""

    symbol: np.ndarray      # id -> symbol
    share: np.ndarray       # id -> log probability given its symbol
    cls: np.ndarray         # symbol -> class
    prior: np.ndarray       # [previous symbol, class] log probability
    within: np.ndarray      # [previous symbol, symbol] log probability given the class
    start: int              # symbol that stands before a text


def tables(unigrams: np.ndarray, bigrams: np.ndarray, top: np.ndarray, end: int, classes: int = 64,
           smooth: float = 20.0, seed: int = 5) -> Tables:
    """Smoothed bigrams of symbols, cut into classes of symbols that follow
    similar symbols (k-means on a randomised projection)."""
    n = len(top) + 1
    symbol = np.full(len(unigrams), n - 1)
    symbol[top] = np.arange(n - 1)
    p = unigrams + 0.5
    other = symbol == n - 1
    share = np.where(other, np.log(p / p[other].sum() if other.any() else 1.0), 0.0)
    by_symbol = np.bincount(symbol, weights=p, minlength=n)
    by_symbol = by_symbol / by_symbol.sum()
    b = bigrams.astype(np.float64)
    pair = (b + smooth * by_symbol[None]) / (b.sum(1, keepdims=True) + smooth)
    cls = _classes(b, by_symbol, classes, seed)
    mass = np.stack([pair[:, cls == c].sum(1) for c in range(classes)], 1)
    with np.errstate(divide="ignore"):
        prior = np.maximum(np.log(mass), -80.0)
        within = np.log(pair / mass[:, cls])
    return Tables(symbol.astype(np.int32), share.astype(np.float32), cls, prior.astype(np.float32),
                  within.astype(np.float32), int(symbol[end]))


def _classes(b: np.ndarray, weight: np.ndarray, classes: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    f = np.sqrt(b.T + 1e-9) / np.sqrt(b.T.sum(1, keepdims=True) + 20)
    q, _ = np.linalg.qr(f @ (f.T @ (f @ rng.standard_normal((len(f), 40)))))
    u, s, _ = np.linalg.svd(q.T @ f, full_matrices=False)
    z = (q @ u)[:, :32] * s[:32]
    centre = z[rng.choice(len(z), classes, replace=len(z) < classes, p=weight / weight.sum())]
    cls = np.zeros(len(z), np.int64)
    for _ in range(25):
        cls = ((z ** 2).sum(1)[:, None] - 2 * z @ centre.T + (centre ** 2).sum(1)).argmin(1)
        for c in range(classes):
            own = cls == c
            centre[c] = np.average(z[own], axis=0, weights=weight[own]) if own.any() else z[rng.integers(len(z))]
    return cls


Params = dict[str, np.ndarray]


def fresh(symbols: int, classes: int, d: int = 16, hidden: int = 32, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    return {"embed": (0.5 * rng.standard_normal((symbols, d))).astype(np.float32), "query": r(d, d), "key": r(d, d),
            "value": r(d, d), "lag": np.zeros(WIDTH, np.float32), "mix": r(2 * d, hidden),
            "bias": np.zeros(hidden, np.float32), "out": 0.01 * r(hidden, classes)}


_AT = np.arange(WIDTH)
_LAG = np.maximum(_AT[:, None] - _AT[None], 0)
_AHEAD = _AT[:, None] < _AT[None]


class Space:
    """Arrays of a gradient, used again for each part of its windows: what
    they hold stays in the processor's cache, and none is allocated anew."""

    def __init__(self, w: Params, t: Tables, part: int = 32):
        d, hidden, classes = w["query"].shape[0], w["mix"].shape[1], t.prior.shape[1]
        n, kind = part * WIDTH, w["embed"].dtype
        f = lambda *s: np.empty(s, kind)
        self.part = part
        self.x, self.z, self.qkv, self.h, self.dh, self.y = f(n, d), f(n, 2 * d), f(n, 3 * d), f(n, hidden), f(n, hidden), f(n, classes)
        self.prior = np.empty((n, classes), t.prior.dtype)
        self.a, self.ds, self.o, self.do = f(part, WIDTH, WIDTH), f(part, WIDTH, WIDTH), f(part, WIDTH, d), f(part, WIDTH, d)
        self.turned = f(part, d, WIDTH)
        self.dz, self.dqkv = f(n, 2 * d), f(n, 3 * d)
        self.at = np.arange(n) * classes
        self.ones = np.ones(max(n, classes), kind)


def _times(x: np.ndarray, w: np.ndarray, out: np.ndarray, rows: int = 256) -> np.ndarray:
    """x @ w into ``out`` for a long thin x, in slices of so many rows where it has whole ones."""
    if len(x) % rows:
        return np.matmul(x, w, out=out)
    np.matmul(x.reshape(-1, rows, x.shape[1]), w, out=out.reshape(-1, rows, out.shape[1]))
    return out


def _outer(x: np.ndarray, y: np.ndarray, rows: int = 256) -> np.ndarray:
    """x.T @ y for long thin matrices, in slices of so many rows."""
    n = len(x) // rows * rows
    out = x[n:].T @ y[n:]
    if n:
        out += np.matmul(x[:n].reshape(-1, rows, x.shape[1]).transpose(0, 2, 1), y[:n].reshape(-1, rows, y.shape[1])).sum(0)
    return out


def gradient(w: Params, t: Tables, windows: np.ndarray, space: Space | None = None, with_loss: bool = True) -> tuple[float, Params]:
    """Mean loss (nats; 0 unless ``with_loss``) and gradients over windows
    [n, WIDTH + 1] of symbols, -1 after the end of a text."""
    sp = space or Space(w, t)
    kind, d = w["embed"].dtype, w["query"].shape[0]
    scale = kind.type(1 / math.sqrt(d))
    inp, tgt = np.maximum(windows[:, :-1], 0).ravel(), windows[:, 1:].ravel()
    live = (tgt >= 0).astype(kind)
    live /= max(1, np.count_nonzero(live))
    cls = t.cls.take(np.maximum(tgt, 0))
    qkv = np.concatenate([w["query"] * scale, w["key"], w["value"]], 1)
    lag = np.where(_AHEAD, 0, np.exp(w["lag"])[_LAG]).astype(kind)
    qkv_t, out_t, mix_t = (np.ascontiguousarray(m.T) for m in (qkv, w["out"], w["mix"]))
    dx = np.empty((len(inp), d), kind)
    loss = 0.0
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g_qkv, g_lag = np.zeros_like(qkv), np.zeros_like(lag)
    for lo in range(0, len(inp), sp.part * WIDTH):
        own = slice(lo, lo + sp.part * WIDTH)
        at, on = inp[own], live[own]
        n = len(at)
        b = n // WIDTH
        x, z, h, dh, y, p, dz, f, df = (m[:n] for m in (sp.x, sp.z, sp.h, sp.dh, sp.y, sp.prior, sp.dz, sp.qkv, sp.dqkv))
        a, ds, o, do, turned = sp.a[:b], sp.ds[:b], sp.o[:b], sp.do[:b], sp.turned[:b]
        w["embed"].take(at, 0, out=x, mode="clip")
        _times(x, qkv, f)
        q, k, v = np.split(f.reshape(b, WIDTH, -1), 3, 2)
        # attention; weights stay undivided, their sums divide what they are applied to
        np.copyto(turned, k.transpose(0, 2, 1))
        np.matmul(q, turned, out=a)
        if a.max() > 60:
            a[:, _AHEAD] = -1e9
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a *= lag
        total = a.reshape(n, WIDTH) @ sp.ones[:WIDTH, None]
        np.matmul(a, v, out=o)
        flat_o = o.reshape(n, d)
        flat_o /= total
        z[:, :d], z[:, d:] = x, flat_o
        _times(z, w["mix"], h)
        h += w["bias"]
        np.tanh(h, out=h)
        _times(h, w["out"], y)
        y += t.prior.take(at, 0, out=p, mode="clip")
        np.exp(y, out=y)  # see Scorer: the sum neither vanishes nor overflows
        mass = y @ sp.ones[:y.shape[1]]
        target = sp.at[:n] + cls[own]
        flat_y = y.reshape(-1)
        if with_loss:
            loss -= float(((np.log(flat_y[target] / mass) + t.within[at, np.maximum(tgt[own], 0)]) * on).sum())
        y *= (on / mass)[:, None]
        flat_y[target] -= on
        g["out"] += _outer(h, y)
        _times(y, out_t, dh)
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        g["mix"] += _outer(z, dh)
        g["bias"] += sp.ones[:n] @ dh
        _times(dh, mix_t, dz)
        np.divide(dz[:, d:], total, out=do.reshape(n, d))
        np.copyto(turned, v.transpose(0, 2, 1))
        np.matmul(do, turned, out=ds)
        ds -= np.einsum("bij,bij->bi", do, o)[..., None]
        ds *= a
        g_lag += ds.sum(0)
        dq, dk, dv = np.split(df.reshape(b, WIDTH, -1), 3, 2)
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 2, 1), q, out=dk)
        np.matmul(a.transpose(0, 2, 1), do, out=dv)
        g_qkv += _outer(x, df)
        _times(df, qkv_t, dx[own])
        dx[own] += dz[:, :d]
    g["query"], g["key"], g["value"] = g_qkv[:, :d] * scale, g_qkv[:, d:2 * d], g_qkv[:, 2 * d:]
    g["lag"] = np.bincount(_LAG[~_AHEAD], weights=g_lag[~_AHEAD], minlength=WIDTH).astype(kind)
    if len(inp):
        order = np.argsort(inp.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else inp, kind="stable")
        rows = inp[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        g["embed"][rows[first]] = np.add.reduceat(dx.take(order, 0), first, axis=0)
    return loss, g


def train(w: Params, t: Tables, windows: np.ndarray, steps: int, rate: float, batch: int = 256, seed: int = 9,
          once: bool = False) -> Params:
    """Adam with a rate that falls to zero; batches are drawn with replacement,
    or with ``once`` deal out the windows, each to one of the steps."""
    rng = np.random.default_rng(seed)
    dealt = np.array_split(rng.permutation(len(windows)), steps) if once else None
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    space = Space(w, t)
    for i in range(1, steps + 1):
        _, g = gradient(w, t, windows[dealt[i - 1] if once else rng.integers(0, len(windows), batch)], space, with_loss=False)
        for k in w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            step = rate * (1 - (i - 1) / steps) * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-8)
            w[k] -= step.astype(np.float32)
    return w


class Scorer:
    """Log10 probabilities of symbol sequences."""

    def __init__(self, w: Params, t: Tables):
        self.t = t
        d = w["query"].shape[0]
        e = w["embed"]
        self.q = e @ w["query"] / np.float32(math.sqrt(d))
        self.k, self.v = e @ w["key"], e @ w["value"]
        self.x = e @ w["mix"][:d] + w["bias"]
        self.o, self.out = w["mix"][d:], w["out"]
        at = np.arange(OVERLAP, WIDTH)
        lag = at[:, None] - _AT[None]
        self.lag = w["lag"][np.maximum(lag, 0)]
        self.lag = np.where(lag >= 0, np.exp(self.lag), 0).astype(np.float32)  # weight of each place in the window
        self.within = t.within.reshape(-1)
        self.cls = t.cls.astype(np.int32)
        self.ones = np.ones((max(WIDTH, self.out.shape[1]), 1), np.float32)
        self.space: dict[str, np.ndarray] = {}

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """One log10 probability per text of ids (the last one the end id)."""
        return self.score_flat(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))

    def score_flat(self, ids: np.ndarray, bounds: np.ndarray, batch: int = 40) -> np.ndarray:
        """The same for texts in a row."""
        t = self.t
        length = np.diff(bounds)
        n = -(-length // STRIDE)  # windows of each text
        base = np.cumsum(OVERLAP + n * STRIDE) - (OVERLAP + n * STRIDE)
        size = int((OVERLAP + n * STRIDE).sum())
        inp, tgt = np.full(size + 1, t.start, np.int32), np.full(size, -1, np.int32)
        at = np.arange(len(ids)) + np.repeat(base + OVERLAP - bounds[:-1], length)
        tgt[at] = t.symbol[ids]
        inp[at + 1] = tgt[at]
        inp[base + OVERLAP] = t.start
        doc = np.repeat(np.arange(len(length)), n)
        no = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = base[doc] + no * STRIDE
        total = np.zeros(len(start))
        for a in range(0, len(start), batch):
            at = start[a:a + batch, None] + _AT
            total[a:a + batch] = self._windows(inp[at], tgt[at[:, OVERLAP:]], no[a:a + batch] == 0)
        out = np.bincount(doc, weights=total, minlength=len(length))
        out += np.bincount(np.repeat(np.arange(len(length)), length), weights=t.share[ids], minlength=len(length))
        return out / math.log(10)

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of that shape, in memory that is used again."""
        size = math.prod(shape)
        if name not in self.space or len(self.space[name]) < size:
            self.space[name] = np.empty(size, np.float32)
        return self.space[name][:size].reshape(shape)

    def _windows(self, inp: np.ndarray, tgt: np.ndarray, first: np.ndarray) -> np.ndarray:
        t = self.t
        b, d, rows = len(inp), self.q.shape[1], len(inp) * STRIDE
        inp = inp.astype(np.int64)
        flat = inp[:, OVERLAP:].ravel()
        taken = lambda m, name, at: m.take(at, 0, out=self._room(name, *at.shape, m.shape[1]), mode="clip")
        q, k, v = taken(self.q, "q", flat).reshape(b, STRIDE, d), taken(self.k, "k", inp), taken(self.v, "v", inp)
        turned = self._room("turned", b, d, WIDTH)
        np.copyto(turned, k.transpose(0, 2, 1))
        a = np.matmul(q, turned, out=self._room("a", b, STRIDE, WIDTH))
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= self.lag
        a[first, :, :OVERLAP] = 0  # nothing stands before a text
        o = np.matmul(a, v, out=self._room("o", b, STRIDE, d)).reshape(rows, d)
        o /= a.reshape(rows, WIDTH) @ self.ones[:WIDTH]
        h = _times(o, self.o, self._room("h", rows, self.o.shape[1]), 10 * STRIDE)
        h += taken(self.x, "x", flat)
        np.tanh(h, out=h)
        y = _times(h, self.out, self._room("y", rows, self.out.shape[1]), 10 * STRIDE)
        y += taken(t.prior, "prior", flat)
        real = tgt.ravel()
        target = np.maximum(real, 0)
        got = y.reshape(-1)[np.arange(rows) * y.shape[1] + self.cls[target]] + self.within[flat * len(t.within) + target]
        # the prior's greatest entry is at least 1 / classes and corrections are
        # bounded by the weights, so the sum neither vanishes nor overflows
        np.exp(y, out=y)
        got -= np.log(y @ self.ones[:y.shape[1], 0])
        return np.where(real >= 0, got, 0).reshape(b, STRIDE).sum(1)


# --- Spark ---------------------------------------------------------------------------

def in_training(id_col: str, folds: int = 7, held_out: int = 2) -> Column:
    """Training rows: crc32 of the id as text modulo ``folds`` is not ``held_out`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) != held_out


@dataclass
class Model:
    tables: Tables
    params: Params
    hot: dict[str, int]  # counts of the frequent words in training texts


def _sequences(symbols: np.ndarray, start: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """Training windows of the symbols of one text, or of texts in a row, padded with -1."""
    bounds = np.array([0, len(symbols)]) if bounds is None else bounds
    length = np.diff(bounds)
    n = -(-length // WIDTH)
    size = n * WIDTH + 1
    base = np.cumsum(size) - size
    row = np.full(int(size.sum()), -1, np.int32)
    row[base] = start
    row[np.arange(len(symbols)) + np.repeat(base + 1 - bounds[:-1], length)] = symbols
    first = np.repeat(base, n) + WIDTH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return row[first[:, None] + np.arange(WIDTH + 1)]


def fit(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id", top: int = 2048,
        hot_words: int = 150_000, sample_rows: int = 4000, sample_windows: int = 16,
        steps: int = 400, seed: int = 23) -> Model:
    """Train on the rows of :func:`in_training`.

    The symbols are the ``top`` most frequent ids of all training texts.  A
    bounded sample (about ``sample_rows`` texts, up to ``sample_windows``
    windows each) picks the ``hot_words`` and gives the network its first
    ``steps``.  All counts cover every training text: per previous symbol
    one row of sparse counts a task crosses the network, and the driver
    receives one row per symbol and hot word.  The network then goes on, in
    parallel, on every window of every training text; the tasks' parameters
    are averaged by slices, weighted by ids seen."""
    return _fit(docs, docs.filter(in_training(id_col)), path, pattern, text, id_col, top, hot_words, sample_rows, sample_windows,
                steps, seed)[0]


def _fit(docs: DataFrame, encoded: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id", top: int = 2048,
         hot_words: int = 150_000, sample_rows: int = 4000, sample_windows: int = 16,
         steps: int = 400, seed: int = 23) -> tuple[Model, DataFrame]:
    """The model of ``docs``, and the ids of the texts of ``encoded``, which holds the training rows (see :func:`_coded`)."""
    rows = docs.filter(in_training(id_col)).select(whole(text).alias("text"), F.xxhash64(F.lit(seed), id_col, text).alias("h"))
    total = rows.count()
    part = min(1.0, sample_rows / total) if total else 1.0
    sampled = rows.filter(F.pmod("h", F.lit(1_000_003)) < int(part * 1_000_003) + 1)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = words_of(path, pattern)
        for pdf in batches:
            for texts in portions(pdf["text"].tolist()):
                c = cut(texts)
                flat, bounds = enc.ids(c)
                windows = []
                for x in np.split(flat, bounds[1:-1]):
                    s = _sequences(x, enc.end)
                    # the choice of windows depends on the text alone
                    rng = np.random.default_rng([seed, len(x)])
                    windows += [r.tobytes() for r in s[rng.permutation(len(s))[:sample_windows]]]
                n = np.bincount(c.at, minlength=len(c.words))
                yield pd.DataFrame({"kind": ["w"] * len(c.words) + ["s"] * len(windows),
                                    "key": [w.encode() for w in c.words] + windows, "n": n.tolist() + [0] * len(windows)})

    picked = settled(sampled.mapInPandas(pick, "kind string, key binary, n long"))
    common = picked.filter("kind <> 's'").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    enc = words_of(path, pattern)
    hot = [bytes(r["key"]).decode() for r in common.filter("kind = 'w' and n > 0").orderBy(F.desc("n"), "key").limit(hot_words).select("key").collect()]
    every, of_hot = _coded(encoded, path, pattern, text, id_col, hot)
    train_ids = every.filter("train").select("n", "ids")
    unigrams = _unigrams(train_ids, enc)
    frequent = np.argsort(-unigrams, kind="stable")[:np.count_nonzero(unigrams)]
    top_ids = [i for i in frequent.tolist() if i != enc.end][:top - 1] + [enc.end]
    windows = sorted(bytes(r["key"]) for r in picked.filter("kind = 's'").select("key").collect())
    top_ids = np.array(top_ids)
    bigrams = _bigrams(train_ids, top_ids, enc)
    t = tables(unigrams, bigrams, top_ids, enc.end)
    w = fresh(len(top_ids) + 1, t.prior.shape[1])
    if windows:
        seen = np.frombuffer(b"".join(windows), np.int32).reshape(-1, WIDTH + 1)
        w = train(w, t, np.where(seen >= 0, t.symbol[np.maximum(seen, 0)], -1), steps, 0.006)
        w = _continue(train_ids, enc.kind, t, w)
    return Model(t, w, of_hot), every


def _packing() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _coded(docs: DataFrame, path: str, pattern: str, text: str, id_col: str, hot: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(id, th, train, n, ids) for each row of ``docs``, its text encoded once
    and kept for all later passes, and how often the ``hot`` words come in
    training texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    hot_no = {w: i for i, w in enumerate(hot)}
    columns = ["id", "th", "train", "n", "ids", "slice", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack, get = words_of(path, pattern), _packing(), hot_no.get
        words, id_type = np.zeros(len(hot) + 1, np.int64), None
        for batch in batches:
            done, id_type = 0, batch.column("id").type
            for texts in text_portions([batch.select(["text"])]):
                part = batch.slice(done, len(texts))
                done += len(texts)
                c = cut(texts)
                flat, bounds = enc.ids(c)
                flat = flat.astype(enc.kind)
                learnt = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(c.bounds))
                np.add.at(words, np.fromiter((get(w, -1) + 1 for w in c.words), np.int64, len(c.words)),
                          np.bincount(c.at[learnt], minlength=len(c.words)))
                ends = bounds.tolist()
                ids = [pack.compress(flat[a:b].tobytes(), asbytes=True) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in columns[:3]), pa.array(np.diff(bounds), pa.int32()), pa.array(ids, pa.binary()),
                     pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], names=columns)
        if words[1:].any():
            slices = _slices(words[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(slices), t) for t in (id_type, pa.int64(), pa.bool_(), pa.int32(), pa.binary())]
                + [pa.array([k for k, _ in slices], pa.int32()), pa.array([_pack(x) for _, x in slices], pa.binary())], names=columns)

    got = settled(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), in_training(id_col).alias("train"),
                              whole(text).alias("text"))
                  .mapInArrow(encode, f"id {kind}, th long, train boolean, n int, ids binary, slice int, counts binary"))
    counts = _joined(_summed(got.filter("slice is not null").select(F.col("slice").cast("long").alias("k"), "counts")), len(hot))
    return got.filter("slice is null").select(*columns[:5]), dict(zip(hot, counts.tolist()))


def _id_portions(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """The ids of consecutive rows, about ``IDS`` together, their bounds and the rows themselves."""
    unpack = _packing().decompress
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + IDS, "right")))
            part = batch.slice(lo, hi - lo)
            flat = b"".join([unpack(x, k * kind.itemsize, asbytes=True) for x, k in zip(part.column("ids").to_pylist(), n[lo:hi].tolist())])
            yield np.frombuffer(flat, kind), np.concatenate([[0], upto[lo:hi] - upto[lo] + n[lo]]), part
            lo = hi


def _slices(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Parts of a vector that are summed by different tasks."""
    return list(enumerate(np.array_split(x, SLICES)))


def _joined(slices: dict[int, np.ndarray], size: int) -> np.ndarray:
    return np.concatenate([slices[k] for k in sorted(slices)]) if slices else np.zeros(size, np.int64)


def _unigrams(coded: DataFrame, enc: Words) -> np.ndarray:
    """Counts of the ids over all training texts."""
    size, kind = enc.size, enc.kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids = np.zeros(size, np.int64)
        for flat, _, _ in _id_portions(batches, kind):
            ids += np.bincount(flat, minlength=size)
        yield _counts_batch(_slices(ids) if ids.any() else [])

    return _joined(_summed(coded.mapInArrow(count, "k long, counts binary")), size)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the packed ``counts`` for each ``k``."""
    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for c in pdf["counts"]:
            x = _unpack(c)
            total = x if total is None else total + x
        return pd.DataFrame({"k": [key[0]], "counts": [_pack(total)]})

    return {r["k"]: _unpack(r["counts"]) for r in parts.groupBy("k").applyInPandas(add, "k long, counts binary").collect()}


def _bigrams(coded: DataFrame, top_ids: np.ndarray, enc: Words) -> np.ndarray:
    """Counts of symbol pairs over all training texts."""
    n, kind = len(top_ids) + 1, enc.kind
    symbol = np.full(enc.size, n - 1, np.int64)
    symbol[top_ids] = np.arange(n - 1)
    start = int(symbol[enc.end])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pairs = np.zeros(n * n, np.int32)
        for flat, _, _ in _id_portions(batches, kind):
            s = symbol[flat]
            # a text follows the end id of the one before, which is its start symbol
            np.add.at(pairs, np.concatenate([[start], s[:-1]]) * n + s, np.int32(1))
        pairs = pairs.reshape(n, n)
        seen = np.flatnonzero(pairs.any(1))
        for at in range(0, len(seen), 64):  # few previous symbols' rows at a time
            yield _counts_batch([(int(p), pairs[p]) for p in seen[at:at + 64]])

    bigrams = np.zeros((n, n), np.int64)
    for p, x in _summed(coded.mapInArrow(count, "k long, counts binary")).items():
        bigrams[p] = x
    return bigrams


def _counts_batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([_pack(x) for _, x in rows], pa.binary())],
                                      names=["k", "counts"])


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.asarray(x, np.int64).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.int64)


def _flat(w: Params) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(x: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


SLICES = 32


def _continue(coded: DataFrame, kind: np.dtype, t: Tables, w: Params, chunk: int = 4096) -> Params:
    """One round of local training per task, averaged."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, own, seen = [], w, 0

        def learn(own: Params) -> Params:
            x = np.concatenate(held)
            return train(own, t, x, -(-len(x) // 256), 0.002, once=True)

        for flat, bounds, _ in _id_portions(batches, kind):
            seen += len(flat)
            s = _sequences(t.symbol[flat], t.start, bounds)
            lo = 0
            for n in (-(-np.diff(bounds) // WIDTH)).tolist():
                for at in range(lo, lo + n, chunk):
                    held.append(s[at:min(at + chunk, lo + n)])
                    if sum(map(len, held)) >= chunk:
                        own = learn(own)
                        held.clear()
                lo += n
        if held:
            own = learn(own)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()),
                 pa.array([p.tobytes() for p in np.array_split(_flat(own), SLICES)], pa.binary())], names=["part", "n", "values"])

    def average(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, float(pdf["n"].sum())
        for v, k in zip(pdf["values"], pdf["n"]):
            total = total + np.frombuffer(v, np.float32).astype(np.float64) * (k / n)
        return pd.DataFrame({"part": [key[0]], "values": [total.astype(np.float32).tobytes()]})

    got = coded.mapInArrow(local, "part int, n long, values binary").groupBy("part") \
        .applyInPandas(average, "part int, values binary").collect()
    if not got:
        return w
    return _shaped(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(got, key=lambda r: r["part"])]), w)


def score(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are the words and one end; ``n_known`` of them occur in training
    texts, which have ``train_tokens``; ``base_score`` is their add-one unigram
    log10 probability and ``score`` the model's log10 probability of the text.
    Null and empty texts are the end alone; repeated rows are scored and
    counted as often as they come; an empty table gives no rows."""
    m, coded = _fit(docs, docs, path, pattern, text, id_col, **fit_args)
    spark = docs.sparkSession
    model, hot = spark.sparkContext.broadcast((m.tables, m.params)), spark.sparkContext.broadcast(m.hot)
    train_row = in_training(id_col)
    ids_kind = words_of(path, pattern).kind
    kind = docs.schema[id_col].dataType.simpleString()

    def own_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        t, params = model.value
        scorer = Scorer(params, t)
        for flat, bounds, part in _id_portions(batches, ids_kind):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("id", "th", "train")), pa.array(scorer.score_flat(flat, bounds))],
                                             names=["id", "th", "train", "score"])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        logs = {w: math.log10(c + 1) for w, c in hot.value.items()}
        get, rows = logs.get, 0
        for batch in batches:
            done = 0
            for texts in text_portions([batch.select(["text"])]):
                c = cut(texts)
                of_word = np.fromiter((get(w, -1.0) for w in c.words), np.float64, len(c.words))
                rare = of_word[c.at] < 0
                n = np.diff(np.concatenate([[0], np.cumsum(rare)])[c.bounds])
                # a text without rare words has one entry that is no word
                at, none = c.at[rare], np.flatnonzero(n == 0)
                at = np.insert(at, (np.cumsum(n) - n)[none], len(c.words) + np.arange(len(none)))
                words = pa.array(c.words + [f" {i}" for i in range(rows, rows + len(none))], pa.string()).take(pa.array(at))
                rows += len(none)
                n[none] = 1
                part = batch.slice(done, len(texts))
                done += len(texts)
                own = pa.StructArray.from_arrays(
                    [pa.array(np.diff(c.bounds)), pa.array(c.per_text(np.maximum(of_word, 0))),
                     pa.array(c.per_text((of_word > 0).astype(float)).astype(np.int64))], names=["n_words", "hot_log", "hot_known"])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in ("id", "th", "train")), own,
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), words)],
                    names=["id", "th", "train", "own", "words"])

    own = settled(coded.mapInArrow(own_score, f"id {kind}, th long, train boolean, score double"))
    # rows that share their id are told apart by a hash of the text as well
    unique = own.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty() and \
        own.filter("id is null").isEmpty()
    key = F.xxhash64(text) if not unique else F.lit(0).cast("long")
    rare = docs.select(F.col(id_col).alias("id"), key.alias("th"), train_row.alias("train"), whole(text).alias("text")) \
        .mapInArrow(rare_words, f"id {kind}, th long, train boolean, own struct<n_words: long, hot_log: double, hot_known: long>, words array<string>") \
        .select("id", "th", "train", "own", F.posexplode("words").alias("pos", "word")) \
        .select("id", "th", "train", "word", F.when(F.col("pos") == 0, F.col("own")).alias("own"))
    by_word = Window.partitionBy("word")
    counted = rare.withColumn("c", F.sum(F.col("train").cast("long")).over(by_word)) \
        .withColumn("first", F.row_number().over(by_word.orderBy("word")) == 1)
    real = ~F.startswith("word", F.lit(" "))
    per_row = settled(counted.groupBy("id", "th").agg(
        F.sum(F.when(real, F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("rare_log"),
        F.sum((real & (F.col("c") > 0)).cast("long")).alias("rare_known"),
        F.sum((real & F.col("first") & (F.col("c") > 0)).cast("long")).alias("new_words"),
        F.sum((real & F.col("train")).cast("long")).alias("train_words"),
        *[F.max(F.col("own")[k]).alias(k) for k in ("n_words", "hot_log", "hot_known")]))
    ends = own.filter("train").count()
    g = per_row.agg(F.coalesce(F.sum("new_words"), F.lit(0)).alias("v"), F.coalesce(F.sum("train_words"), F.lit(0)).alias("n")).first()
    n_train = g["n"] + sum(m.hot.values()) + ends
    v_train = g["v"] + sum(c > 0 for c in m.hot.values()) + (ends > 0)
    th = F.col("th") if not unique else F.lit(0).cast("long")
    left = own.withColumn("key", th).groupBy("id", "key").agg(
        *[F.first(c).alias(c) for c in ("train", "score")], F.count(F.lit(1)).alias("copies"))
    right = per_row.select(F.col("id").alias("rid"), F.col("th").alias("rkey"), "rare_log", "rare_known", "n_words", "hot_log", "hot_known")
    both = left.join(right, F.col("id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("n_words") + 1
    base = F.col("hot_log") + zero("rare_log") / F.col("copies") + F.lit(math.log10(ends + 1)) \
        - n_tokens * F.lit(math.log10(n_train + v_train + 1))
    return both.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), n_tokens.alias("n_tokens"),
                       (F.col("hot_known") + F.floor(zero("rare_known") / F.col("copies")) + int(ends > 0)).cast("long").alias("n_known"),
                       F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                       F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
