"""SimHash near-duplicate detection with a binary-trie self-join.

Fingerprints are 64-bit SimHashes of word shingles.  All pairs within a
Hamming budget are found by walking the binary trie of the distinct
fingerprints against itself: a pair of nodes at the same depth carries the
number of bits in which their prefixes differ, and is dropped once that
exceeds the budget.

On the cluster a node pair at depth d is the pair (prefix, xor mask of the
two prefixes).  A fingerprint joins the pairs of its own prefix with every
mask of at most ``budget`` bits.  Node pairs with few members are finished
inside one task (the walk goes on bit by bit, in numpy); larger ones go down
further levels first, so no group outgrows a task however the fingerprints
cluster.  Tasks return spanning links only, so dense groups stay linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import release, settled, utf8, whole

#: Fixed value: seed of the shingle hash.
SEED = 42
BITS = 64
#: A fingerprint is hot from this share (one in so many) of the rows.
HOT = 1000


def simhash(raw: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text (UTF-8 bytes): lower-case A-Z,
    split at ASCII white space, hash every run of ``shingle`` words (all words
    when there are fewer); a bit is set when over half of the hashes have it.
    A text without words gives zero."""
    words = raw.lower().split()
    if not words:
        return 0
    ones = np.zeros(BITS, np.int64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 16384):  # bounded memory for very long texts
        part = words[at:min(at + 16384, n) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [part]
        h = b"".join([digest(b" ".join(g), seed) for g in grams])
        bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    @F.pandas_udf("long")
    def fp(raw: pd.Series) -> pd.Series:
        release()
        return pd.Series(np.array([simhash(x, shingle) for x in raw], np.uint64).astype(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(utf8(text)).alias("fp"))


def masks(bits: int, budget: int) -> list[int]:
    """All ``bits``-bit numbers with at most ``budget`` ones."""
    return [sum(1 << b for b in c) for k in range(min(budget, bits) + 1) for c in combinations(range(bits), k)]


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, err: int, budget: int,
         frontier: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with popcount(a[i] ^ b[j]) <= budget.

    ``a`` and ``b`` are sorted distinct unsigned fingerprints whose first
    ``depth`` bits are constant in each and differ in ``err`` bits; ``b`` =
    None joins ``a`` with itself (i < j).  Node pairs are ranges of the sorted
    arrays.  The frontier is cut into pieces of ``frontier`` node pairs that
    are finished one after another, which bounds memory."""
    own = b is None
    if own:
        b = a
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_i, found_j = [], []
    stack = [(depth, np.array([[0, len(a), 0, len(b), err]], np.int64))]
    while stack:
        d, nodes = stack.pop()
        if len(nodes) > frontier:
            stack += [(d, nodes[k:k + frontier]) for k in range(0, len(nodes), frontier)]
            continue
        na, nb = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        small = (na * nb <= 16) | (d >= BITS)
        if small.any():
            i, j = _products(nodes[small])
            keep = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                keep &= i < j
            found_i.append(i[keep])
            found_j.append(j[keep])
            nodes = nodes[~small]
        if not len(nodes):
            continue
        shift = np.uint64(BITS - 1 - d)
        ma = nodes[:, 1] - _ones(a, shift, nodes[:, 0], nodes[:, 1])
        mb = ma if own and a is b and np.array_equal(nodes[:, 0:2], nodes[:, 2:4]) else \
            nodes[:, 3] - _ones(b, shift, nodes[:, 2], nodes[:, 3])
        lo_a, hi_a, lo_b, hi_b, e = nodes.T
        same = (lo_a == lo_b) & (hi_a == hi_b) if own else np.zeros(len(nodes), bool)
        kids = [np.stack([lo_a, ma, lo_b, mb, e], 1), np.stack([ma, hi_a, mb, hi_b, e], 1),
                np.stack([lo_a, ma, mb, hi_b, e + 1], 1),
                np.stack([ma, hi_a, lo_b, mb, e + 1], 1)[~same]]  # of a node with itself once
        nxt = np.concatenate(kids)
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budget)]
        if len(nxt):
            stack.append((d + 1, nxt))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _ones(x: np.ndarray, shift: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((x >> shift) & np.uint64(1))]).astype(np.int64)
    return total[hi] - total[lo]


def _products(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the node pairs' ranges."""
    na, nb = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
    size = na * nb
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(nb, size)
    return np.repeat(nodes[:, 0], size) + k // wide, np.repeat(nodes[:, 2], size) + k % wide


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """root[k] for k < n: the smallest index connected with k by the links."""
    root = np.arange(n)
    while len(i):
        ri, rj = root[i], root[j]
        low = np.minimum(ri, rj)
        np.minimum.at(root, ri, low)
        np.minimum.at(root, rj, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _solve(budget: int):
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        depth, mask, low = (int(x) for x in key)
        fp = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        if mask == 0:
            i, j = walk(fp, None, depth, 0, budget)
        else:
            prefix = fp >> np.uint64(BITS - depth) if depth else np.zeros_like(fp)
            cut = prefix == np.uint64(low)
            a_at, b_at = np.flatnonzero(cut), np.flatnonzero(~cut)
            i, j = walk(fp[a_at], fp[b_at], depth, mask.bit_count(), budget)
            i, j = a_at[i], b_at[j]
        root = spanning(i, j, len(fp))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[at].view(np.int64), "v": fp[root[at]].view(np.int64)})
    return solve


def trie_links(distinct: DataFrame, n: int, budget: int = 2, node_size: int = 1000,
               task_rows: int = 20000) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``distinct(fp)`` (``n`` rows)
    that connect everything within ``budget`` bits: a spanning forest of each
    trie node pair, so two fingerprints are in one component exactly when a
    chain of links within the budget joins them.

    The first cut has about ``node_size`` fingerprints a node; node pairs over
    ``task_rows`` members are taken down eight levels at a time until they
    are smaller or their fingerprints are fully distinguished."""
    depth = min(24, max(0, round(math.log2(max(1, n) / node_size))))
    schema = "u long, v long"
    pairs = _descend(distinct.select("fp", F.lit(0).cast("long").alias("mask")), 0, depth, budget)
    out = None
    while True:
        key = [F.lit(depth).alias("depth"), F.col("mask"), F.col("low")]
        if depth >= BITS - 8:
            big = None
        else:
            big = pairs.groupBy("mask", "low").agg(F.count(F.lit(1)).alias("_n")) \
                .filter(F.col("_n") > task_rows).select("mask", "low")
            big = settled(big)
            if big.isEmpty():
                big = None
        small = pairs if big is None else pairs.join(big, ["mask", "low"], "left_anti")
        found = small.select(*key, "fp").groupBy("depth", "mask", "low").applyInPandas(_solve(budget), schema)
        out = found if out is None else out.unionByName(found)
        if big is None:
            return out
        rest = settled(pairs.join(big, ["mask", "low"], "left_semi").select("fp", "mask"))
        pairs = _descend(rest, depth, 8, budget)
        depth += 8


def _descend(rows: DataFrame, depth: int, steps: int, budget: int) -> DataFrame:
    """Replace each (fp, mask) at ``depth`` by its node pairs ``steps`` levels
    down; ``low`` is the smaller prefix of the pair."""
    to = depth + steps
    if steps:
        by_ones = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks(steps, budget - k)])
                            for k in range(budget + 1)])
        rows = rows.select("fp", "mask", F.explode(F.get(by_ones, F.bit_count("mask").cast("int"))).alias("_m")) \
            .select("fp", F.shiftleft("mask", steps).bitwiseOR(F.col("_m")).alias("mask"))
    prefix = F.shiftrightunsigned("fp", BITS - to) if to else F.lit(0).cast("long")
    return rows.select("fp", "mask", F.least(prefix, prefix.bitwiseXOR(F.col("mask"))).alias("low"))


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; root is the smallest
    node of its component (large-star / small-star rounds until nothing
    changes).  Group minima are partial aggregates and the joins back are on
    the unskewed side's unique key, so a star's hub costs no single task."""
    edges = settled(_oriented(links))
    state = _digest(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = _oriented(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u")
        edges = _oriented(hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .unionByName(low.select("u", F.col("m").alias("v"))))
        edges = settled(edges)
        now = _digest(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller end."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    x = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return x[0], x[1]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                    budget: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) per row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the
    smallest id among the rows reachable over fingerprints that differ in at
    most ``budget`` bits.  Null and word-free texts have fingerprint zero and
    link like any other.  A null id takes part in links but never names a
    component; a component with null ids only has component_id null.  Repeated
    rows are returned as often as they come; an empty table gives no rows."""
    fps = settled(fingerprints(docs, id_col, text, shingle))
    classes = settled(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    size = classes.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    links = trie_links(classes.select("fp"), size["classes"], budget)
    linked = components(links).withColumnRenamed("node", "fp")
    reach = linked.join(classes, "fp").groupBy("root").agg(F.min("low").alias("component"))
    named = classes.join(linked.join(reach, "root").select("fp", "component"), "fp", "left") \
        .select("fp", F.coalesce("component", "low").alias("component_id"), "n")
    # fingerprints of at least a thousandth of the rows are at most a thousand: their
    # rows find their class by broadcast, so no task of the other join gets a hot key
    hot = F.broadcast(named.filter(F.col("n") * HOT >= size["rows"]).select("fp", "component_id"))
    rest = fps.join(hot, "fp", "left_anti").join(named.drop("n"), "fp")
    return fps.join(hot, "fp").unionByName(rest).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
             budget: int = 2) -> DataFrame:
    """One document of each component, all columns unchanged: the row with the
    smallest id (null ids last), of rows that repeat that id with different texts
    one with the smallest text hash, of rows of one id and text any one.  An
    empty table gives no rows.

    A row is known by its id and 64 bits of its text.  The lost ones leave by an
    anti join, so a text crosses the network at most once (not at all when the
    list of lost rows is small enough to broadcast); only rows that repeat id
    and text are grouped."""
    def row(alias: str) -> Column:
        return F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(text)).alias("k")).alias(alias)

    found = settled(near_duplicates(docs.select(row("key"), F.col(f"`{text}`").alias("text")), "key", "text", shingle, budget))
    lost = found.filter(F.col("key") != F.col("component_id")).select("key").distinct()
    repeated = settled(found.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row("key"))
    left = rows.join(lost, "key", "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    one = left.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return left.join(repeated, "key", "left_anti").unionByName(one).select("row.*")
