"""Token ids in a compact binary file: canonical length-limited Huffman code.

Writing: texts become ids (the tokenizers library), rows are put in ascending
id order over ``files`` range buckets, ids are counted over the whole corpus,
one code is built from the counts, and each bucket is written as segments.
A segment is a run of whole documents with their lengths, the index of its
first token in the corpus, the bit offset of every ``BLOCK``-th token and the
code bits; so each block can be decoded on its own.  Segments are the rows of
a Parquet dataset (written through Spark's commit protocol), the code lengths
are a second dataset beside it.

Reading decodes all blocks of a segment in step, one table look-up a token.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import held, release, settled, shuffle_width, whole
from vigil.llm.pieces import SPACE_CUT_PATTERN, PieceEncoder, uncollected
from vigil.session import ensure_checkpoint_dir, settings

BLOCK = 1024
SEGMENT = 1 << 20  # tokens after which a segment is closed
LIMIT = 16  # longest code, unless the vocabulary needs more
BATCH = 2500  # rows that are texts in a worker at a time
TOGETHER = 1 << 22  # characters of the texts that are cut together


# --- ids -----------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself for visible Latin-1 characters, the next from 256 on for others."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryPieces(PieceEncoder):
    """Pieces by a byte-level merge model of the tokenizers library.

    A merge over the border of two words would need a token with a byte that
    ends the first before the space of the second.  Words that end in no such
    byte go through the model several in one call, and their ids are told apart
    by the tokens' lengths in bytes."""

    _in_order = False  # the merge model keeps nothing from one word to the next

    def __init__(self, tok, together: int, group: int = 8):
        self._model = model = tok.model
        self._letters_of = letters = _byte_letters()
        vocab = tok.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self._bytes[list(vocab.values())] = [len(t) for t in vocab]
        before_space = {t[i - 1] for t in vocab for i in range(1, len(t)) if t[i] == letters[32]}
        self._joining = {b for b, c in letters.items() if c in before_space}
        alone = model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix
        self._group = 1 if alone else group
        super().__init__(SPACE_CUT_PATTERN, None, scale=2, together=together)

    def _ids(self, pieces: Iterable[str]) -> Iterable[bytes]:
        raw = [p.encode("utf-8") for p in pieces]
        if self._group == 1 or len(raw) == 1 or not all(p[0] == 32 for p in raw):
            return [self._tokens([p]).tobytes() for p in raw]
        parts, open_ = [], []
        for p in raw:
            open_.append(p)
            if len(open_) == self._group or p[-1] in self._joining:
                parts.append(b"".join(open_))
                open_ = []
        if open_:
            parts.append(b"".join(open_))
        return self._split(self._tokens(parts), raw)

    def _tokens(self, raw: Iterable[bytes]) -> array:
        """The ids of all strings, in a row."""
        ids, tokenize = array("i"), self._model.tokenize
        for p in raw:
            ids.extend([t.id for t in tokenize(self._lettered(p))])
        return ids

    def _lettered(self, raw: bytes) -> str:
        """The characters that stand for the bytes; visible ASCII stands for itself."""
        p = raw.decode("latin-1")
        if p.isascii() and p.isprintable():
            return p.replace(" ", self._letters_of[32])
        return p.translate(self._letters_of)

    def _split(self, ids: array, raw: list[bytes]) -> list[bytes]:
        """The ids of each string."""
        ends = np.cumsum(self._bytes[np.frombuffer(ids, np.int32)])
        upto = (np.searchsorted(ends, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))) + 1).tolist()
        packed = ids.tobytes()
        return [packed[4 * a:4 * b] for a, b in zip([0, *upto], upto)]


class Ids:
    """Ids by the tokenizers library, without special tokens.

    Its byte-level pre-tokenizer cuts texts by the public pattern; each
    distinct piece goes through the library's merge model once.  Pieces with
    characters beyond Latin-1, where the two pattern engines might differ, go
    through the whole library with the text they are in."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self._tok.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._cached = LibraryPieces(self._tok, TOGETHER)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        beyond = [i for i, t in enumerate(texts) if not t.isascii() and _BEYOND_LATIN(t)]
        if beyond:
            texts, given = list(texts), texts
            for i in beyond:
                texts[i] = ""
        out = self._cached.encode_many(texts)
        out = [x.astype(self.kind) for x in out]
        for i in beyond:
            out[i] = np.array(self._tok.encode(given[i], add_special_tokens=False).ids, self.kind)
        return out


_BEYOND_LATIN = re.compile("[^\0-\u00ff]").search


def encoder(path: str) -> Ids:
    return held(("ids", path), lambda: Ids(path))


# --- the code --------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); symbols
    that do not occur get 0.  A single symbol gets one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items, is_leaf = both[order], order < n
    need = 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:need].sum())
        out[used[:k]] += 1
        need = 2 * (need - k)
    return out


class Code:
    """Canonical code of given lengths: codes rise with (length, symbol)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.longest = int(lengths.max(initial=1))
        # a symbol's code, left-aligned in `longest` bits, is the sum of the widths before it
        width = 1 << (self.longest - lengths[order].astype(np.int64))
        begin = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin >> (self.longest - lengths[order].astype(np.int64))).astype(np.uint64)
        self._order, self._width = order, width
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next ``longest`` bits."""
        if self._table is None:
            symbol = np.zeros(1 << self.longest, np.uint32)
            filled = np.repeat(self._order, self._width)
            symbol[:len(filled)] = filled
            self._table = symbol, self.lengths[symbol].astype(np.int64)
        return self._table

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """Code bits (most significant first) and the bit offsets of blocks."""
        lengths, words, begin, offsets = self.lengths.astype(np.int64), [np.zeros(1)], 0, []
        for i in range(0, len(ids), block * 32):  # what fits into a processor's cache
            part = ids[i:i + block * 32]
            size = lengths[part]
            end = np.cumsum(size) + (begin & 31)
            at = end - size
            word = at >> 5
            value = self.codes[part] << (64 - (at & 31) - size).astype(np.uint64)
            n = int(end[-1] >> 5) + 1
            # the bits of different tokens are disjoint: sums are unions, below 2^32
            high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
            high[:n] += np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:n]
            high[0] += words[-1][-1]  # begun by the part before
            words[-1] = words[-1][:-1]
            words.append(high[:n])
            offsets.append(at[::block] + (begin & ~31))
            begin = (begin & ~31) + int(end[-1])
        words = np.pad(np.concatenate(words), (0, 1 if begin & 31 else 0)) if offsets else np.zeros(0)
        return words.astype(np.uint32).astype(">u4").tobytes(), np.concatenate([np.zeros(0, np.int64), *offsets])

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The ``n`` ids; every block starts from its own offset."""
        if not n:
            return np.zeros(0, np.int64)
        symbol, length = self.table()
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        top, mask = 32 - self.longest, (1 << self.longest) - 1
        at = offsets.astype(np.int64)
        out = np.zeros((min(block, n), len(at)), symbol.dtype)  # a step writes one row
        last = n - (len(at) - 1) * block
        for k in range(min(block, n)):
            if k == last:  # the last block is done
                at, live = at[:-1], slice(0, len(at) - 1)
            elif k == 0:
                live = slice(0, len(at))
            code = window[at >> 3] >> (top - (at & 7)) & mask
            out[k, live] = symbol[code]
            at = at + length[code]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


# --- files -------------------------------------------------------------------------

def _bucket_edges(docs: DataFrame, id_col: str, files: int) -> list:
    """The greatest id of all but the last of about ``files`` equal id ranges
    (one value a file; only the id column is read)."""
    spread = docs.select(F.col(id_col).alias("id")).filter("id is not null").repartitionByRange(files, "id")
    top = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("top")).collect()
    return sorted(r["top"] for r in top)[:-1]


def _packing() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts that are cut together."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= TOGETHER:
            yield texts[at:i + 1]
            at, chars = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                 end_id: int = 0, files: int | None = None) -> None:
    """Write the ids of every text, ``end_id`` after each, to ``path``.

    Rows go in ascending id order, null ids last, rows of equal id ordered by
    a hash of their text.  Null texts count as empty (only the end id);
    repeated rows are all written; an empty table gives empty datasets."""
    spark = docs.sparkSession
    files = files or shuffle_width(spark)
    edges = _bucket_edges(docs, id_col, files)
    kind = docs.schema[id_col].dataType.simpleString()

    @F.pandas_udf("bucket int, n int, ids binary")
    def to_ids(key: pd.Series, body: pd.Series) -> pd.DataFrame:
        enc, pack = encoder(tokenizer), _packing()
        n, ids = [], []
        with uncollected():
            for texts in _portions(body.tolist()):
                for x in enc.encode_many(texts):
                    x = np.append(x, enc.kind.type(end_id))
                    n.append(len(x))
                    ids.append(pack.compress(x.tobytes(), asbytes=True))
                pa.default_memory_pool().release_unused()
        bucket = np.full(len(key), len(edges))
        known = key.notna().to_numpy()
        if edges:
            bucket[known] = np.searchsorted(np.array(edges), key[known].to_numpy())
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "n": n, "ids": ids})

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), to_ids(F.col(id_col), whole(text)).alias("x")) \
        .select("id", "tie", "x.*")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        rows = settled(rows.repartition(files, "bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_last(), "tie"))
    width = encoder(tokenizer).kind

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros(0, np.int64)
        unpack = _packing().decompress
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                c = np.bincount(np.frombuffer(b"".join([unpack(x, n * width.itemsize, asbytes=True) for x, n in zip(part["ids"], part["n"])]), width))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[:len(c)] += c
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "c": total[used]})

    # one row per id of the vocabulary and one per file reach the driver
    per_id = rows.select("ids", "n").mapInPandas(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(encoder(tokenizer).size, np.int64)
    for r in per_id:
        counts[r["id"]] = r["c"]
    lengths = code_lengths(counts)
    first, at = {}, 0
    for b, n in sorted((r["bucket"], r["n"]) for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        first[b], at = at, at + n

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, open_, where = Code(lengths), [], dict(first)
        unpack = _packing().decompress

        def close() -> pd.DataFrame:
            bucket = open_[0][0]
            ids = np.frombuffer(b"".join([unpack(x[3], x[2] * width.itemsize, asbytes=True) for x in open_]), width)
            bits, offsets = code.encode(ids)
            row = {"file": bucket, "first_token": where[bucket], "doc_ids": [x[1] for x in open_],
                   "doc_tokens": [x[2] for x in open_], "block_bits": offsets.tolist(), "bits": bits}
            where[bucket] += len(ids)
            open_.clear()
            return pd.DataFrame([row])

        held = 0
        for pdf in batches:
            for row in zip(pdf["bucket"], pdf["id"].astype(object).where(pdf["id"].notna(), None), pdf["n"], pdf["ids"]):
                if open_ and (row[0] != open_[0][0] or held >= SEGMENT):
                    yield close()
                    held = 0
                open_.append(row)
                held += row[2]
        if open_:
            yield close()

    rows.mapInPandas(segments, f"file int, first_token long, doc_ids array<{kind}>, doc_tokens array<int>, "
                               "block_bits array<long>, bits binary").write.mode("overwrite").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/code")


def read_tokens(spark: SparkSession, path: str, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files: (id, start, n_tokens, ids array), with
    ``digest`` the crc32 of the ids (little-endian unsigned 32-bit) instead
    of the ids.  ``start`` counts the ids of all documents before."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    table = spark.read.parquet(f"{path}/segments")
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(lengths)
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                n = np.asarray(s.doc_tokens, np.int64)
                ends = np.cumsum(n)
                ids = code.decode(s.bits, np.asarray(s.block_bits), int(ends[-1])).astype("<u4")
                parts = np.split(ids, ends[:-1])
                yield pd.DataFrame({"id": s.doc_ids, "start": s.first_token + ends - n, "n_tokens": n,
                                    "x": [zlib.crc32(p.tobytes()) for p in parts] if digest else [p.astype(np.int64) for p in parts]})

    return table.mapInPandas(documents, f"id {kind}, start long, n_tokens long, x {'long' if digest else 'array<long>'}") \
        .withColumnsRenamed({"id": id_col, "x": "ids_crc32" if digest else "ids"})


def scratch_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
