"""Byte-level BPE as a lazily determinised finite-state transducer.

Merge ranks are compiled into a transducer that reads bytes and writes token
ids.  Two facts make it finite: every prefix of a BPE token sequence is the
BPE sequence of its bytes, and a sequence is BPE exactly when each pair of
neighbours is (merging the pair's bytes gives the pair back).  So each byte
position has one possible last token, found by testing the vocabulary
entries that end there against the last token at their start.

A state is (last committed token, bytes not committed yet).  A token is
committed - written - as soon as the paths of all positions from which some
vocabulary entry may still continue agree on it, so the lookahead is
bounded by the longest entry.  States and transitions are made when an input
first needs them.  Decoding runs the token bytes through an incremental
UTF-8 machine whose state is the unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import held, whole
from vigil.llm.pieces import PieceEncoder, uncollected

#: Most numbered states of a worker (beyond them, states are made and dropped;
#: after as many again the table starts anew) and most cached pair tests (a
#: full cache is emptied).  Results do not depend on it.
STATES = 1 << 19
_NEVER = 1 << 62


class _Read:
    """What is known of the bytes after the last committed token, last[0]."""

    __slots__ = ("data", "last", "ends", "live")

    def __init__(self, data: bytes, last: list[int], ends: list[int], live: list[int]):
        self.data = data
        self.last = last  # last[i]: last token of the first i bytes
        self.ends = ends  # ends[i]: bit set of the token ends on the path to i
        self.live = live  # positions from which an entry may still continue


class Transducer:
    """Encodes one piece of text at a time by merge ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], scale: int = 0):
        self.limit = STATES >> scale
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}  # proper prefixes of entries
        self._pairs: dict[tuple[int, int], bool] = {}
        self._spines: dict[int, tuple | None] = {}
        self._reset()

    def _reset(self) -> None:
        # a state is (last committed token, bytes after it), numbered when first reached
        self._numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self._next: dict[int, int] = {}   # number << 8 | byte -> number of the next state << 1 | writes tokens
        self._out: dict[int, tuple[int, ...]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}  # what a state writes when the piece ends
        self._states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self._unkept = 0

    def merges(self, data: bytes, stop: bytes | None = None) -> list[bytes]:
        """Merge the neighbours of lowest rank (leftmost first) until no
        neighbours form an entry, or until the next merge would give ``stop``."""
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        pair = [rank(data[i:i + 2], _NEVER) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == _NEVER:
                break
            i = pair.index(low)
            if len(parts) == 2 and parts[0] + parts[1] == stop:
                break
            parts[i] += parts.pop(i + 1)
            pair.pop(i)
            if i < len(pair):
                pair[i] = rank(parts[i] + parts[i + 1], _NEVER)
            if i:
                pair[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
        return parts

    def spines(self, token: int) -> tuple | None:
        """(left spine, right spine, in order) of a token that merges of its
        own bytes give, else None.  A spine lists the parts that reach that
        end of the token, from the token down to a byte, as (bytes, rank at
        which it forms, rank at which it merges further); ``in order``: every
        part forms at a higher rank than its own parts."""
        if token in self._spines:
            return self._spines[token]
        data = self.bytes_of[token]
        if len(data) == 1:
            got = [(data, -1, _NEVER)], [(data, -1, _NEVER)], True
        elif len(self.merges(data)) != 1:
            got = None
        else:
            # the parts before the last merge: the pair of entries that is final without it
            left, right = self.merges(data, stop=data)
            a, b = self.spines(self.ranks[left]), self.spines(self.ranks[right])
            got = ([(data, token, _NEVER), (left, a[0][0][1], token), *a[0][1:]],
                   [(data, token, _NEVER), (right, b[1][0][1], token), *b[1][1:]],
                   a[2] and b[2] and token > a[0][0][1] and token > b[1][0][1])
        self._spines[token] = got
        return got

    def follows(self, a: int, b: int) -> bool:
        """May token b come after token a (a = -1: at the start)?  Not if
        merges would cross the boundary: a part at the right end of a and one
        at the left end of b that exist at the same time and form an entry
        before either merges away from the boundary."""
        key = (a, b)
        got = self._pairs.get(key)
        if got is not None:
            return got
        y = self.spines(b)
        if y is None or a < 0:
            got = y is not None
        else:
            x = self.spines(a)
            if x[2] and y[2]:
                got = True
                for left, left_from, left_to in x[1]:
                    for right, right_from, right_to in y[0]:
                        t = self.ranks.get(left + right)
                        if t is not None and (at := max(t, left_from, right_from)) < left_to and at <= right_to:
                            got = False
            else:
                got = self.merges(self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
        if len(self._pairs) > self.limit:
            self._pairs.clear()
        self._pairs[key] = got
        return got

    def _read(self, data: bytes, last: tuple[int, ...]) -> _Read:
        """A state's positions from its bytes and their last tokens."""
        ends = [1]
        for at in range(1, len(last)):
            start = at - len(self.bytes_of[last[at]])
            ends.append(ends[start] | 1 << at if start >= 0 else 0)
        live = [at for at in range(len(data)) if data[at:] in self.open]
        live.append(len(data))
        return _Read(data, list(last), ends, live)

    def _extend(self, r: _Read, byte: int) -> _Read:
        text = r.data + bytes((byte,))
        n = len(text)
        live, token = [], None
        # an entry that ends here started at a position that was still live
        for at in r.live:
            part = text[at:]
            if token is None:
                got = self.ranks.get(part)
                if got is not None and self.follows(r.last[at], got):
                    token, ends = got, r.ends[at] | 1 << n
            if part in self.open:
                live.append(at)
        if token is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        live.append(n)
        return _Read(text, [*r.last, token], [*r.ends, ends], live)

    def _commit(self, r: _Read) -> tuple[_Read, tuple[int, ...]]:
        """Write the tokens up to the last boundary that the paths of all live
        positions share."""
        common = -1
        for k in r.live:
            common &= r.ends[k]
        cut = common.bit_length() - 1
        if not cut:
            return r, ()
        return _Read(r.data[cut:], r.last[cut:], [x >> cut for x in r.ends[cut:]], [k - cut for k in r.live]), self._tokens(r, cut)

    def _tokens(self, r: _Read, at: int) -> tuple[int, ...]:
        """The path of position ``at``."""
        out = []
        while at > 0:
            out.append(r.last[at])
            at -= len(self.bytes_of[r.last[at]])
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is an entry is that entry."""
        return next(self.encode_all((piece,)))

    def encode_all(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """:meth:`encode` of each piece.  The bytes that a piece shares with
        the start of the one before are not read again, so pieces in order
        cost least."""
        step, before, out = self._next, b"", []
        path = [(0, None, 0)]  # after each byte: state (-1: not kept), its positions if at hand, ids written
        for piece in pieces:
            whole_piece = self.ranks.get(piece)
            if whole_piece is not None:
                yield [whole_piece]
                continue
            if self._unkept > self.limit:  # the kept states no longer suit the input
                self._reset()
            if step is not self._next:  # a new table, perhaps made for another caller
                step, before = self._next, b""
            shared = len(commonprefix((before, piece)))
            del path[shared + 1:]
            before = piece
            state, r, written = path[shared]
            del out[written:]
            for byte in piece[shared:]:
                key = state << 8 | byte
                hit = step.get(key) if state >= 0 else None
                if hit is not None:
                    if hit & 1:
                        out += self._out[key]
                    state, r = hit >> 1, None
                else:
                    state, r = self._step(state, r, byte, out)
                path.append((state, r, len(out)))
            if state < 0:
                yield out + list(self._tokens(r, len(r.data)))
                continue
            tail = self._ends.get(state)
            if tail is None:
                r = r or self._read(*self._states[state])
                tail = self._ends[state] = self._tokens(r, len(r.data))
            yield [*out, *tail]

    def _step(self, state: int, r: _Read | None, byte: int, out: list[int]) -> tuple[int, _Read]:
        """A transition that is not known yet; the ids it writes go to ``out``."""
        r, tokens = self._commit(self._extend(r or self._read(*self._states[state]), byte))
        out += tokens
        name = (r.last[0], r.data)
        number = self._numbers.get(name, -1)
        if number < 0:
            if len(self._states) < self.limit:
                number = self._numbers[name] = len(self._states)
                self._states.append((r.data, tuple(r.last)))
            else:
                self._unkept += 1
        if state >= 0 and number >= 0:
            key = state << 8 | byte
            self._next[key] = number << 1 | bool(tokens)
            if tokens:
                self._out[key] = tokens
        return number, r


class _Row(dict):
    """Token -> (text it completes, row of the next state) in one state."""

    __slots__ = ("machine", "state")

    def __init__(self, machine: Utf8Machine, state: bytes):
        self.machine, self.state = machine, state

    def __missing__(self, token: int):
        hit = self[token] = self.machine.step(self.state, token)
        return hit


class Utf8Machine:
    """Incremental UTF-8 decoder.  The state is the bytes of an unfinished
    character; what tokens do in a state is computed once.  Bytes that cannot
    be part of a character become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._rows: dict[bytes, _Row] = {}

    def _row(self, state: bytes) -> _Row:
        got = self._rows.get(state)
        if got is None:
            got = self._rows[state] = _Row(self, state)
        return got

    def step(self, state: bytes, token: int) -> tuple[str, _Row]:
        text, after = self.run(state, self.bytes_of[token])
        return text, self._row(after)

    @staticmethod
    def expected(state: bytes) -> tuple[int, int, int]:
        """(bytes that the character still needs, least and greatest next
        byte); (0, 0, 0) when the lead byte starts no character."""
        lead = state[0]
        need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
        if not need:
            return 0, 0, 0
        low, high = 0x80, 0xBF
        if len(state) == 1:  # no overlong forms, surrogates or values over U+10FFFF
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        return need + 1 - len(state), low, high

    def run(self, state: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            if state:
                _, low, high = self.expected(state)
                if low <= byte <= high:
                    state += bytes((byte,))
                    if self.expected(state)[0] == 0:
                        out.append(state.decode("utf-8"))
                        state = b""
                    continue
                out.append("\ufffd")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif self.expected(bytes((byte,)))[0]:
                state = bytes((byte,))
            else:
                out.append("\ufffd")
        return "".join(out), state

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text completed by each token; an unfinished character at the end
        becomes U+FFFD."""
        row = self._row(b"")
        for token in ids:
            text, row = row[token]
            yield text
        if row.state:
            yield "\ufffd"

    def text(self, ids: Iterable[int]) -> str:
        """The whole of :meth:`stream`."""
        row, out = self._row(b""), []
        add = out.append
        for token in ids:
            part, row = row[token]
            add(part)
        if row.state:
            add("\ufffd")
        return "".join(out)


class Codec:
    """Encoder and decoder of a rank file; pieces are the pattern's matches.
    Each step of ``scale`` halves the caches, each of ``fewer`` the states once more."""

    def __init__(self, path: str, pattern: str, scale: int = 0, fewer: int = 0):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(self.ranks, scale + fewer)
        self.machine = Utf8Machine(self.transducer.bytes_of)
        self.decimal = [str(i) for i in range(max(self.ranks.values(), default=-1) + 1)]
        pieces = PieceEncoder(pattern, lambda ps: self.transducer.encode_all(p.encode("utf-8") for p in ps), scale)
        self.encode, self.encode_many = pieces.encode, pieces.encode_many

    def decode(self, ids: Iterable[int]) -> str:
        return self.machine.text(ids)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str, scale: int = 1, fewer: int = 0) -> Codec:
    return held(("codec", path, pattern, scale, fewer), lambda: Codec(path, pattern, scale, fewer))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids`` (array of int): the text's token ids, without
    special tokens.  Null and empty texts give an empty array; an existing
    column of that name is replaced; an empty table gives no rows."""
    @F.pandas_udf("array<int>")
    def to_ids(body: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        with uncollected():
            return pd.Series(c.encode_many(body.tolist()), dtype=object)

    return docs.withColumn(ids, to_ids(whole(text)))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns and ``text``: the ids decoded (null ids: empty text)."""
    @F.pandas_udf("string")
    def to_text(rows: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.decode(x.tolist() if x is not None else ()) for x in rows], dtype=object)

    return tokens.withColumn(text, to_text(F.col(ids)))


def encode_checked(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns but the text, then ``n_tokens``, ``ids`` and ``intact``:
    whether the ids decode to the text again.  Nulls as in :func:`encode`;
    columns of these names are replaced."""
    made = ("n_tokens", "ids", "intact")
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in made]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("intact", T.BooleanType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], whole(text).alias("_whole_text")) \
        .mapInArrow(lambda batches: _checked(batches, path, pattern, schema.names), schema)


def _checked(batches: Iterator[pa.RecordBatch], path: str, pattern: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A task of :func:`encode_checked`; the texts are the last column.  The
    rows carry the ids, so the worker keeps little else: small caches, and no
    freed memory in Arrow's pool."""
    c, rest = codec(path, pattern, 2, 2), len(names) - 3
    with uncollected():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few rows' ids at a time
                part = batch.slice(at, 256)
                texts = part.column(rest).to_pylist()
                ids = c.encode_many(texts)
                size = np.array([0, *map(len, ids)])
                intact = [c.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([*part.columns[:rest], pa.array(size[1:], pa.int64()), lists, pa.array(intact, pa.bool_())],
                                                 names=names)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: the ids of the text
    (decimal, comma-joined) and the text decoded from them, as digests.  Null
    texts count as empty; repeated rows come as often as they are."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(body: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        rows, decimal = [], c.decimal.__getitem__
        with uncollected():
            for ids in c.encode_many(body.tolist()):
                ids = ids.tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(),
                             hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(whole(text)).alias("_d")).select(id_col, "_d.*")
