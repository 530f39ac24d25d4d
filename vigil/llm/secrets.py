"""Secret scans with a linear-chain conditional random field.

A text is cut into tokens (runs of letters and digits, single other
characters).  The field tags tokens as beginning of, inside or outside a
secret from the token's shape, the shapes and keywords of its neighbours and
two features of the whole text; Viterbi decoding gives the spans.  Fixed
patterns find the base spans; the field adds spans that overlap none of them.

The field is trained on windows of a bounded sample of documents, labelled
by the base patterns; keyword features are dropped at random in training so
that shape and context count as well.

Decoding is exact but cheap: in all but a few places the score of "outside"
exceeds the others by more than transitions can win back, so Viterbi only
runs in windows around the other tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import release, whole

#: The base patterns and their least lengths, in listing order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
#: What an assignment can start with, as found in lower-cased bytes.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words near a secret, by group.
KEYWORDS = (("password", "passwd", "pwd", "passphrase", "pass"), ("secret", "private", "credential", "credentials"),
            ("token", "bearer", "auth", "authorization"), ("api", "apikey", "access", "key", "keys"),
            ("login", "user", "username", "account", "id"))

LABELS = 3  # outside, begin, inside
OUT, BEGIN, IN = range(LABELS)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, start of the value) of the base patterns,
    ordered by start and kind; leftmost non-overlapping per kind, matches
    that are too short dropped."""
    out = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a greedy run of hex digits of the least length is the whole run
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out)


# --- tokens and features ---------------------------------------------------

_LOWER, _UPPER, _DIGIT, _WIDE, _NOHEX = 1, 2, 4, 8, 16
_EDGES = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40])
_WORD_SHAPES = 32 * (len(_EDGES) + 1)
SHAPES = _WORD_SHAPES + 128 + 1  # words, single ASCII characters, none (beyond the text)
NONE = SHAPES - 1
WORDS = len(KEYWORDS) + 1
FILES = 16


def _classes() -> np.ndarray:
    """Per ASCII code: bits of a word character, 64 for other visible ones, 0 for white space."""
    t = np.full(128, 64, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[48:58] = _DIGIT
    t[65:91] = _UPPER | _NOHEX
    t[97:123] = _LOWER | _NOHEX
    t[97:103] = _LOWER
    return t


_CLASS = _classes()
_WORD_GROUP = {w: g + 1 for g, ws in enumerate(KEYWORDS) for w in ws}
_WORD_KEYS = np.unique([len(w) << 16 | ord(w[0]) << 8 | ord(w[-1]) for w in _WORD_GROUP])


@dataclass
class Tokens:
    """Tokens of a text: code point positions and the features' numbers."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    file: int

    def features(self) -> np.ndarray:
        """[token, feature]: numbers of the active features in one joint index."""
        n = len(self.start)
        pad_s = np.concatenate([[NONE] * 3, self.shape, [NONE] * 2])
        pad_w = np.concatenate([[0] * 3, self.word, [0] * 2])
        cols = [pad_s[3:3 + n], pad_s[2:2 + n], pad_s[1:1 + n], pad_s[4:4 + n],
                pad_w[3:3 + n], pad_w[2:2 + n], pad_w[1:1 + n], pad_w[0:n], np.full(n, self.file)]
        return np.stack(cols, 1) + OFFSETS


SIZES = [SHAPES] * 4 + [WORDS] * 4 + [FILES]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
N_FEATURES = int(np.sum(SIZES))
KEYWORD_COLUMNS = range(4, 8)


def tokenize(text: str) -> Tokens:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = np.where(code < 128, _CLASS[np.minimum(code, 127)], _WIDE | _NOHEX).astype(np.uint8)
    word = (cls & 31) > 0
    visible = cls > 0
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(visible & ~(word & before))
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, z, 0)
    # a word ends where the run of word characters ends; other tokens are one character
    stops = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    is_word = word[starts]
    ends = starts + 1
    ends[is_word] = stops
    bits = np.bitwise_or.reduceat(cls & 31, starts)
    # what lies between a token and the next start is white space (no bits)
    length = ends - starts
    shape = np.where(is_word, (bits.astype(np.int64) & 31) * (len(_EDGES) + 1) + np.searchsorted(_EDGES, length, side="right"),
                     _WORD_SHAPES + np.minimum(code[starts], 127).astype(np.int64))
    first, final = code[starts], code[ends - 1]
    group = np.zeros(len(starts), np.int64)
    maybe = np.flatnonzero(is_word & (length <= 16) & (first < 128) & (final < 128))
    key = length[maybe] << 16 | (first[maybe].astype(np.int64) | 32) << 8 | final[maybe].astype(np.int64) | 32
    for t in maybe[np.isin(key, _WORD_KEYS)]:
        group[t] = _WORD_GROUP.get(text[starts[t]:ends[t]].lower(), 0)
    digits = min(3, int(8 * np.count_nonzero(bits & _DIGIT) / len(starts)))
    signs = min(3, int(40 * np.count_nonzero((first == 61) | (first == 58)) / len(starts)))
    return Tokens(starts, ends, shape, group, digits * 4 + signs)


def tag(tokens: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    """Labels that mark the tokens overlapping each span."""
    y = np.zeros(len(tokens.start), np.int8)
    for a, b in spans:
        lo, hi = np.searchsorted(tokens.end, a, side="right"), np.searchsorted(tokens.start, b, side="left")
        y[lo:hi] = IN
        y[lo:lo + 1] = BEGIN if hi > lo else y[lo:lo + 1]
    return y


# --- the field ---------------------------------------------------------------

_FORBIDDEN = -1e4
_SPAN_PAD = 3


@dataclass
class Field:
    """Weights: [feature, label] and [label, next label]; labels start outside."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]]
        for k in range(1, features.shape[1]):
            out = out + self.weights[features[:, k]]
        return out

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best labels.  Relabelling a whole secret as outside changes its
        score by the gains of its tokens plus at most ``bonus`` of transitions
        a token; runs without a token of positive total gain stay outside, and
        no secret reaches more than two such tokens beyond one that has it."""
        y = np.zeros(len(e), np.int8)
        free = self.moves.copy()
        free[OUT, IN] = 0
        bonus = 3 * float(np.abs(free).max())
        hot = np.flatnonzero(np.maximum(e[:, BEGIN], e[:, IN]) - e[:, OUT] + bonus > 0)
        if not len(hot):
            return y
        cut = np.flatnonzero(np.diff(hot) > 2 * _SPAN_PAD + 1)
        lo = np.maximum(hot[np.concatenate([[0], cut + 1])] - _SPAN_PAD, 0)
        hi = np.minimum(hot[np.concatenate([cut, [len(hot) - 1]])] + _SPAN_PAD + 1, len(e))
        for a, b in zip(lo.tolist(), hi.tolist()):
            y[a:b] = self.viterbi(e[a:b])
        return y

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        s_o, s_b, s_i = 0.0, _FORBIDDEN, _FORBIDDEN
        back = []
        for x_o, x_b, x_i in e.tolist():
            o = max((s_o + oo, OUT), (s_b + bo, BEGIN), (s_i + io, IN))
            b = max((s_o + ob, OUT), (s_b + bb, BEGIN), (s_i + ib, IN))
            i = max((s_o + oi, OUT), (s_b + bi, BEGIN), (s_i + ii, IN))
            back.append((o[1], b[1], i[1]))
            s_o, s_b, s_i = o[0] + x_o, b[0] + x_b, i[0] + x_i
        at = max((s_o, OUT), (s_b, BEGIN), (s_i, IN))[1]
        out = []
        for row in reversed(back):
            out.append(at)
            at = row[at]
        return np.array(out[::-1], np.int8)


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.5,
          penalty: float = 1e-5, drop: float = 0.2, seed: int = 3) -> Field:
    """Maximum likelihood by forward-backward and Adam over padded windows
    [window, place, feature], [window, place]; ``drop`` is the share of windows
    that lose their keyword features in a round."""
    rng = np.random.default_rng(seed)
    n, width, k = features.shape
    w, moves = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    real = np.arange(width)[None, :] < lengths[:, None]
    gold = np.eye(LABELS)[labels] * real[..., None]
    seen_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    hold = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    ban = np.zeros((LABELS, LABELS))
    ban[OUT, IN] = _FORBIDDEN
    start = np.array([0, 0, _FORBIDDEN])
    total = max(1, int(real.sum()))
    for r in range(1, rounds + 1):
        used = np.ones((n, k))
        used[np.ix_(rng.random(n) < drop, list(KEYWORD_COLUMNS))] = 0
        e = sum(w[features[:, :, c]] * used[:, None, None, c] for c in range(k))
        t = moves + ban
        alpha = np.empty((width, n, LABELS))
        alpha[0] = start + e[:, 0]
        for i in range(1, width):
            step = _lse(alpha[i - 1][:, :, None] + t, 1) + e[:, i]
            alpha[i] = np.where(real[:, i, None], step, alpha[i - 1])
        beta = np.zeros((width, n, LABELS))
        for i in range(width - 2, -1, -1):
            step = _lse(t[None] + (e[:, i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(real[:, i + 1, None], step, 0.0)
        z = _lse(alpha[-1], 1)
        node = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * real[..., None]
        diff = gold - node
        edge = np.zeros((LABELS, LABELS))
        for i in range(1, width):
            p = np.exp(alpha[i - 1][:, :, None] + t + (e[:, i] + beta[i])[:, None, :] - z[:, None, None])
            edge += (p * real[:, i, None, None]).sum(0)
        gw = np.zeros_like(w)
        for c in range(k):
            for y in range(LABELS):
                gw[:, y] += np.bincount(features[:, :, c].ravel(), weights=(diff[..., y] * used[:, None, c]).ravel(),
                                        minlength=N_FEATURES)
        for x, g, m, v in ((w, gw / total - penalty * w, hold[0], hold[1]),
                           (moves, (seen_moves - edge) / total - penalty * moves, hold[2], hold[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8) * (1 - r / (rounds + 1))
    return Field(w.astype(np.float32), (moves + ban).astype(np.float32))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


# --- Spark -------------------------------------------------------------------

WINDOW = 32
PLAIN = 0.1  # share of sampled documents without secrets that give windows


def _windows(text: str, rng: np.random.Generator, per_document: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a document: around base spans, and at random."""
    t = tokenize(text)
    n = len(t.start)
    if not n:
        return
    y = tag(t, [(v, b) for _, b, _, v in base_spans(text, text.encode("utf-8", "replace"))])
    f = t.features()
    at = np.flatnonzero(y == BEGIN)[:per_document]
    plain = rng.integers(0, n, 2 if len(at) or rng.random() < PLAIN else 0)
    for c in np.concatenate([at - rng.integers(4, WINDOW - 8, len(at)), plain]):
        c = int(min(max(c, 0), max(0, n - WINDOW)))
        if c and y[c] == IN:
            continue
        yield f[c:c + WINDOW], y[c:c + WINDOW]


def fit(docs: DataFrame, text: str = "text", sample_rows: int = 20000, per_document: int = 4, seed: int = 11) -> Field:
    """The field, trained on windows of at most about ``sample_rows``
    documents: a Bernoulli sample of that expected size, of which a document
    with base spans gives at most ``per_document`` + 2 windows of 32 tokens
    and one in ten of the others gives two.  Only those windows reach the
    driver."""
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    picked = docs.select(whole(text).alias("text"))
    if share < 1.0:
        picked = picked.sample(withReplacement=False, fraction=share, seed=seed)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for body in pdf["text"]:
                # what a document gives does not depend on the batch it is in
                rng = np.random.default_rng([seed, len(body)])
                rows += [(f.astype(np.int16).tobytes(), y.tobytes()) for f, y in _windows(body, rng, per_document)]
            yield pd.DataFrame(rows, columns=["f", "y"])

    got = sorted((bytes(r["f"]), bytes(r["y"])) for r in picked.mapInPandas(cut, "f binary, y binary").collect())
    if not got:
        return Field(np.zeros((N_FEATURES, LABELS), np.float32), np.array([[0, 0, _FORBIDDEN], [0] * 3, [0] * 3], np.float32))
    k = len(SIZES)
    lengths = np.array([len(y) for _, y in got])
    features, labels = np.zeros((len(got), WINDOW, k), np.int64), np.zeros((len(got), WINDOW), np.int64)
    for i, (f, y) in enumerate(got):
        features[i, :len(y)] = np.frombuffer(f, np.int16).reshape(-1, k)
        labels[i, :len(y)] = np.frombuffer(y, np.int8)
    return train(features, labels, lengths)


def spans(text: str, field: Field) -> list[tuple[int, int, int, int]]:
    """Base spans and those that the field adds, ordered by start and kind;
    an added span overlaps no base span."""
    found = base_spans(text, text.encode("utf-8", "replace"))
    t = tokenize(text)
    if len(t.start):
        y = field.decode(field.emissions(t.features()))
        begin = np.flatnonzero(y == BEGIN)
        for b in begin.tolist():
            e = b + 1
            while e < len(y) and y[e] == IN:
                e += 1
            a, z = int(t.start[b]), int(t.end[e - 1])
            if all(z <= s[0] or a >= s[1] for s in found):
                found.append((a, z, 3, a))
    return sorted(found)


SPANS = "array<struct<kind:string,start:long,end:long,value_start:long>>"


def find_secrets(docs: DataFrame, text: str = "text", out: str = "spans", sample_rows: int = 20000) -> DataFrame:
    """All columns and ``out``: the spans of every whole text (kind, start,
    end exclusive, start of the secret value; code points), ordered by start
    and then kind (assign, access, hex, crf).

    Null and empty texts have no spans; repeated rows are scanned one by one;
    an empty table gives no rows; an existing column ``out`` is replaced."""
    field = fit(docs, text, sample_rows)

    @F.pandas_udf(SPANS)
    def scan(body: pd.Series) -> pd.Series:
        release()
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "value_start": v} for a, b, k, v in spans(x, field)]
                          for x in body], dtype=object)

    return docs.withColumn(out, scan(whole(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", sample_rows: int = 20000) -> DataFrame:
    """The documents with every secret value replaced by ``mark`` (overlapping
    values by one); ``n_chars``, where there is such a column, follows the
    text.  Other columns, null texts and texts without secrets stay as they
    are; no row is dropped."""
    field = fit(docs, text, sample_rows)

    @F.pandas_udf("string")
    def clean(body: pd.Series) -> pd.Series:
        release()
        return pd.Series([None if x is None else replaced(x, spans(x, field), mark) for x in body], dtype=object)

    done = docs.withColumn(text, clean(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.char_length(text)).otherwise(F.col("n_chars"))
                               .cast(docs.schema["n_chars"].dataType))
    return done


def replaced(text: str, found: list[tuple[int, int, int, int]], mark: str) -> str:
    out, at = [], 0
    for v, b in sorted((v, b) for _, b, _, v in found):
        if v >= at:
            out += [text[at:v], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
