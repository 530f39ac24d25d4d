"""Line dedup against brute force, with hot lines over many partitions, and on odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import lines

UPPER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, id string, k string, pos string, n_dropped string, keep string, _id string, _k string, head string"
EXTRA = ("x",) * 8


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs=10, min_chars=1, keep_first=False):
    """(id, lines, dropped, kept text) per row."""
    docs = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(r)
    gone = {k for k, rs in docs.items() if len(rs) >= min_docs}
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
    seen, out = set(), []
    for r in order:
        kept = []
        for line in (rows[r][1] or "").split("\n"):
            k = key(line)
            if k not in gone or (keep_first and k not in seen):
                kept.append(line)
            seen.add(k)
        n = len((rows[r][1] or "").split("\n"))
        out.append((rows[r][0], n, n - len(kept), "\n".join(kept)))
    return Counter(out)


def made(rng, n):
    common = ["Shared LINE", "  shared line\t", "menu", "été", "ÉTÉ", "", "  ", "a b"]
    rows = []
    for i in range(n):
        body = [rng.choice(common) if rng.random() < 0.4 else f"own {i} {rng.randrange(3)}" for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), "the hot line")
        rows.append((i, "\n".join(body)))
    return rows


def result(df):
    return Counter((r["doc_id"], len((r["old"] or "").split("\n")), r["n_dropped"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("min_docs,min_chars,keep_first", [(10, 1, False), (2, 4, False), (1, 1, True), (10, 1, True), (400, 1, False)])
@pytest.mark.parametrize("width", [1, 40])
def test_lines_equal_brute_force(spark, min_docs, min_chars, keep_first, width):
    rows = made(random.Random(min_docs + width), 500)
    rows += [(None, None), (501, ""), (502, "\n\n"), (503, "menu\r\nmenu\n the hot line \nx" * 300)]
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from pyspark.sql import functions as F
        got = lines.dedup_lines(docs.withColumn("old", F.col("text")), min_docs=min_docs, min_chars=min_chars, keep_first=keep_first)
        assert got.columns == [c for c in docs.columns if c != "n_dropped"] + ["old", "n_dropped"]
        assert result(got) == brute(rows, min_docs, min_chars, keep_first)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_hot_line_is_cut_over_partitions(spark):
    """A line of every document spans many ranges; its count is added up."""
    rows = [(i, f"hot\nown {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = lines.dropped_lines(docs, min_docs=300)
    assert gone.count() == 300 and lines.dropped_lines(docs, min_docs=301).count() == 0


def test_rows_of_one_id(spark):
    """Each row counts as a document; rows of one id and text share a bitmap."""
    rows = [(1, "a\nb")] * 6 + [(1, "a\nc")] * 4 + [(None, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.report(docs)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == {(1, 2, 1): 10, (None, 1, 1): 2}
    sha = {r["kept_sha256"] for r in got.collect()}
    assert sha == {hashlib.sha256(s.encode()).hexdigest() for s in ("b", "c", "")}
    assert lines.keep_bitmaps(docs).count() == 3
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        gone = np.unique(rng.integers(0, n, size=max(1, n // 3)))
        rng.shuffle(gone)
        stay = lines.stays(lines.bitmap(gone), n)
        assert len(stay) == n and set(np.flatnonzero(~stay)) == set(gone)
