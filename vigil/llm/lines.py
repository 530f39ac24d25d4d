"""Line dedup: lines that many documents share, without moving text.

Every line becomes a row of its key's hash, its document and its position.
The rows are range-partitioned by hash, document and position and sorted so,
which also cuts a line of a third of all rows over many tasks; each task
streams over its rows and counts, per hash, the documents' first occurrences.
What leaves are the positions to drop, regrouped per document as compressed
keep bitmaps, which meet the texts again at the end.

A hash that touches an end of its partition may go on in the next one: its
count in each partition, and its rows while they are below the least number of
documents, go through a second, small step that adds the counts up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.common import fresh, settled, utf8, whole

#: Documents that share a line, and code points of its key, from which on it goes.
MIN_DOCS, MIN_CHARS = 10, 1
#: Kinds of rows that leave the stream: drop; undecided; a hash's count in its partition.
DROP, OPEN, COUNT = 0, 1, 2


def key_of(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case (bytes methods
    know ASCII alone)."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def line_rows(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, k, pos, first): 128 bits of each line's key; the row is
    known by its id and 64 bits of its text, and ``first`` marks the key's first
    line in its document."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", kind),
                           T.StructField("k", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("first", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                digests, rows, places, firsts = [], [], [], []
                for row, body in enumerate(part.column(2)):
                    seen = set()
                    for pos, line in enumerate(body.as_py().split(b"\n")):
                        key = key_of(line)
                        if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
                            continue
                        digest = xxhash.xxh3_128_digest(key)
                        digests.append(digest)
                        rows.append(row)
                        places.append(pos)
                        firsts.append(digest not in seen)
                        seen.add(digest)
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at_row = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(at_row), part.column(1).take(at_row),
                     pa.array(places, pa.int32()), pa.array(firsts, pa.bool_())], names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(text)).alias("k"), utf8(text).alias("body")).mapInArrow(cut, schema)


class _Group:
    """The rows of one hash in one partition, as they come.

    Rows are held while the hash has too few documents here, and leave at once
    from then on.  A group that touches no end of the partition is settled
    here; one that does also leaves its count, and what is still held."""

    def __init__(self, key: tuple[int, int], at_start: bool, min_docs: int, keep_first: bool, schema: pa.Schema) -> None:
        self.key, self.at_start, self.min_docs, self.keep_first, self.schema = key, at_start, min_docs, keep_first, schema
        self.docs, self.held, self.begun = 0, [], False

    def leaving(self, rows: pa.Table, kind: int, head: bool = False) -> pa.RecordBatch:
        n = rows.num_rows
        first = np.zeros(n, bool)
        first[:1] = head
        cols = [pa.array(np.full(n, kind, np.int32)), *(rows.column(c).combine_chunks() for c in ("h1", "h2", "id", "k", "pos")),
                pa.nulls(n, pa.int64()), pa.array(first)]
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def add(self, rows: pa.Table, docs: int) -> Iterator[pa.RecordBatch]:
        self.docs += docs
        self.held.append(rows)
        if self.docs < self.min_docs:
            return
        rows = pa.concat_tables(self.held)
        if self.keep_first and not self.begun:
            if self.at_start:  # the first line may be in a partition before this one
                yield self.leaving(rows.slice(0, 1), OPEN, True)
            rows = rows.slice(1)
        self.held, self.begun = [], True
        yield self.leaving(rows, DROP)

    def close(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        if not (self.at_start or at_end):
            return
        count = {"kind": COUNT, "h1": self.key[0], "h2": self.key[1], "n": self.docs, "head": False}
        yield pa.RecordBatch.from_pylist([count], schema=self.schema)
        if self.held:
            yield self.leaving(pa.concat_tables(self.held), OPEN, not self.begun)


def _stream(min_docs: int, keep_first: bool, schema: pa.Schema):
    """The pass over one sorted partition."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            h = np.column_stack([rows.column("h1").to_numpy(), rows.column("h2").to_numpy()])
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(h)]
            docs = np.add.reduceat(rows.column("first").to_numpy().astype(np.int64), starts)
            last = len(starts) - 1
            key = tuple(h[0].tolist())
            if group is None or group.key != key:
                if group is not None:
                    yield from group.close(False)
                group = _Group(key, group is None, min_docs, keep_first, schema)
            yield from group.add(rows.slice(0, ends[0]), int(docs[0]))
            if last:
                yield from group.close(False)
                inner = np.repeat(docs[1:last] >= min_docs, (ends - starts)[1:last])  # groups that are whole in this batch
                if keep_first and inner.size:
                    inner[starts[1:last] - starts[1]] = False
                if inner.any():
                    yield group.leaving(rows.slice(ends[0], len(inner)).filter(pa.array(inner)), DROP)
                group = _Group(tuple(h[-1].tolist()), False, min_docs, keep_first, schema)
                yield from group.add(rows.slice(starts[last]), int(docs[last]))
        if group is not None:
            yield from group.close(True)

    return stream


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                  keep_first: bool = False) -> DataFrame:
    """(id, k, pos) of the lines that go."""
    rows = line_rows(docs, id_col, text, min_chars)
    order = ["h1", "h2", "id", "k", "pos"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = T.StructType([T.StructField("kind", T.IntegerType()), *rows.schema.fields[:5], T.StructField("n", T.LongType()),
                        T.StructField("head", T.BooleanType())])
    found = ordered.mapInArrow(_stream(min_docs, keep_first, to_arrow_schema(out)), out).withColumn("part", F.spark_partition_id())
    found = settled(found)
    total = found.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("origin"))
    goes = F.col("total") >= min_docs
    if keep_first:
        goes = goes & ~(F.col("head") & (F.col("part") == F.col("origin")))
    late = found.filter(F.col("kind") == OPEN).drop("n").join(total, ["h1", "h2"]).filter(goes)
    return found.filter(F.col("kind") == DROP).select("id", "k", "pos").unionByName(late.select("id", "k", "pos"))


def bitmap(dropped: np.ndarray) -> bytes:
    """The compressed bits, one a line up to the byte of the last dropped one: 1
    stays, and so does what comes after."""
    keep = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def stays(keep: bytes, n: int) -> np.ndarray:
    """Whether each of ``n`` lines stays."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].astype(bool)
    return np.concatenate([bits, np.ones(n - len(bits), bool)])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep_first: bool = False) -> DataFrame:
    """(id, k, n_dropped, keep) for each document that loses a line: its id,
    xxhash64 of its text, and the bitmap of the lines that stay
    (:func:`stays`).

    A line's key is the line without blanks at its ends, A-Z in lower case.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines; with ``keep_first`` the first one stays
    (smallest id, nulls first, then position).  Each row is a document of its
    own; rows of one id and one text share a bitmap.  Null and empty texts are one
    empty line; an empty table gives no rows."""
    @F.pandas_udf("n_dropped long, keep binary")
    def packed(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(x), bitmap(np.asarray(x))) for x in lists], columns=["n_dropped", "keep"])

    gone = dropped_lines(docs, id_col, text, min_docs, min_chars, keep_first)
    return gone.groupBy("id", "k").agg(F.collect_set("pos").alias("places")).select("id", "k", packed("places").alias("_p")) \
        .select(F.col("id").alias(id_col), "k", "_p.*")




def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                keep_first: bool = False) -> DataFrame:
    """All rows and columns, the lines that :func:`keep_bitmaps` drops taken
    out of the text (the others joined by a line feed), and ``n_dropped``;
    null texts come back empty."""
    @F.pandas_udf("string")
    def kept(bodies: pd.Series, keeps: pd.Series) -> pd.Series:
        out = []
        for body, keep in zip(bodies, keeps):
            if keep is not None:
                lines = body.split("\n")
                body = "\n".join([line for line, stay in zip(lines, stays(keep, len(lines)).tolist()) if stay])
            out.append(body)
        return pd.Series(out, dtype=object)

    gone, mark = fresh(docs, "gone"), fresh(docs, "text_hash")
    maps = keep_bitmaps(docs, id_col, text, min_docs, min_chars, keep_first).select(F.struct(F.col(id_col).alias("id"), "k", "n_dropped", "keep").alias(gone))
    own = docs.withColumn(mark, F.xxhash64(whole(text)))
    both = own.join(maps, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{gone}.id")) & (F.col(mark) == F.col(f"{gone}.k")), "left")
    hit = F.col(f"{gone}.keep").isNotNull()
    new = F.when(hit, kept(F.when(hit, whole(text)), F.col(f"{gone}.keep"))).otherwise(whole(text))  # other texts stay out of Python
    return both.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "n_dropped"],
                       F.coalesce(F.col(f"{gone}.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) per row."""
    n = F.size(F.split(whole(text), "\n")).cast("long")
    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text"), n.alias("n_lines"))
    return dedup_lines(narrow, id_col).select(id_col, "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle_sql(min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for :func:`report` on ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    blanks = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {blanks}), '{upper}', '{upper.lower()}') AS line_key FROM l),
c AS (SELECT line_key, count(DISTINCT r) AS n FROM k WHERE length(line_key) >= {min_chars} GROUP BY line_key HAVING n >= {min_docs})
SELECT doc_id, count(*) AS n_lines, count(c.n) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.n IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (line_key) GROUP BY r, doc_id"""
