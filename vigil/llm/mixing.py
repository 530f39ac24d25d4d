"""Mixing sources to target weights.

Each source's documents form a stream of words in a keyed random order,
cut into blocks of ``block_words`` words.  A source's target in words is an
exact quota of blocks (the last one cut short), over several passes through
the source when the target exceeds its size.  A splitting tree deals the
quotas out to the output shards: every inner node draws, from a multivariate
hypergeometric distribution, how many blocks of each source go to its left
half.  Within a source the shards draw disjoint ranges of a keyed
permutation of the blocks; rows are shuffled inside their shard.

Every node draws with a generator seeded by its place in the tree, and
ranks are arithmetic, so a repeated task draws the same blocks again.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, settled, shuffle_width, whole

#: Weights of the sources in name order, repeating; most passes through a source.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_PASSES = 3
MAX_BLOCKS = 100_000_000


def word_count(text: str = "text"):
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(src, source_size, target) per source of ``sized(src, size)``.

    Sources in code point order (null last) take the weights in turn.  Targets
    share the whole size by weight; a target stops at ``max_passes`` times its
    source's size and the excess goes to the others by weight, which is the
    level L with sum(min(weight * L, max_passes * size)) = total size.  Sources
    reach their stop in the order of max_passes * size / weight, so L follows
    from running sums over that order (one row per source)."""
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(k, F.lit(len(weights))))
    cap = F.col("source_size") * float(max_passes)
    per = per.withColumn("w", w).withColumn("cap", cap).withColumn("stop", cap / F.col("w"))
    order = Window.orderBy("stop", F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if exactly the sources before this one are stopped
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(after))
    # the first source (in stop order) whose level stays below its stop sets L
    per = per.withColumn("L", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(every)["level"])
    return per.select("src", "source_size",
                      F.least("cap", F.coalesce(F.col("w") * F.col("L"), F.col("cap"))).alias("target"))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of range(n), elementwise: a four-round Feistel
    network on the next even power of two, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x = x.astype(np.uint64)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


class Plan:
    """Block quotas of the sources, and what the shards draw of them."""

    def __init__(self, sources: list[tuple[str | None, int, float]], block_words: int, shards: int, seed: int):
        self.names = [s[0] for s in sources]
        self.size = np.array([s[1] for s in sources], np.int64)
        self.words = np.rint([s[2] for s in sources]).astype(np.int64) if sources else np.zeros(0, np.int64)
        self.block, self.shards, self.seed = block_words, shards, seed
        self.blocks = -(-self.size // block_words)
        self.key = np.array([_mix(seed, i) for i in range(len(sources))], np.uint64)
        full = np.where(self.size > 0, self.words // np.maximum(self.size, 1), 0)
        rest = self.words - full * self.size
        tail = self.size - (self.blocks - 1) * block_words  # words of the last, shorter block
        rank = self._rank(np.maximum(self.blocks - 1, 0), np.arange(len(sources)), full)
        # blocks of the last pass and the words taken of its last block, allowing for
        # the short block when it has been drawn before
        straight = -(-rest // block_words)
        late = rest > rank * block_words
        over = rest - rank * block_words - np.minimum(tail, np.maximum(rest - rank * block_words, 0))
        take = np.where(late, rank + 1 + -(-over // block_words), straight)
        cut_late = np.where(over > 0, over - (-(-over // block_words) - 1) * block_words, rest - rank * block_words)
        self.cut = np.where(take > 0, np.where(late, cut_late, rest - (straight - 1) * block_words), 0)
        self.quota = np.where(self.size > 0, full * self.blocks + take, 0)
        self.last = self.quota - 1  # rank of the block that is cut
        self.cut = np.where(take > 0, self.cut, block_words)

    def _rank(self, block: np.ndarray, src: np.ndarray, epoch: np.ndarray) -> np.ndarray:
        n = np.maximum(self.blocks[src], 1)
        return permute(block, n, self.key[src] + epoch.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    def draw(self, src: np.ndarray, block: np.ndarray, epoch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, words): the draw order of a block in an epoch of its source,
        and how many of its first words are taken (0: not drawn)."""
        rank = epoch * self.blocks[src] + self._rank(block, src, epoch)
        words = np.where(rank < self.quota[src], self.block, 0)
        return rank, np.where(rank == self.last[src], np.minimum(self.cut[src], self.block), words)

    def shard_starts(self) -> np.ndarray:
        """[shard, source]: the first draw rank of each shard, from the leaves
        of the splitting tree; a shard draws up to the next one's first."""
        out = np.zeros((self.shards, len(self.quota)), np.int64)
        todo = [(0, self.shards, np.zeros_like(self.quota), self.quota)]
        while todo:
            lo, hi, first, counts = todo.pop()
            if hi - lo == 1:
                out[lo] = first
                continue
            mid = (lo + hi) // 2
            rng = np.random.default_rng([self.seed, lo, hi])
            left = _hypergeometric(rng, counts, int(counts.sum()) * (mid - lo) // (hi - lo))
            todo += [(lo, mid, first, left), (mid, hi, first + left, counts - left)]
        return out


def _hypergeometric(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source by source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = rng.hypergeometric(c, rest, draws) if draws and c + rest else 0
        draws -= int(out[i])
    return out


def _mix(seed: int, i: int) -> int:
    return int(np.random.default_rng([seed, i]).integers(1, 1 << 63))


def _located(docs: DataFrame, id_col: str, text: str, source: str, seed: int, keep: bool) -> DataFrame:
    """(_id, src, size, offset) per row, with ``keep`` also the row itself as
    struct ``_row``: its source and its word offset in the source's order.

    The order is by a keyed hash of id and text.  Each source is cut into
    slices of that order, so that a hot source is many window groups; running
    sums in a slice start from the totals of the slices before it.  About
    sqrt(rows) slices keep both windows (in a slice, and over a source's
    slices) far below a task's memory."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    x = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("src"), word_count(text).alias("size"),
                    F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("_h"), *row)
    rows = docs.count()
    slices = max(1, rows // max(256, math.isqrt(rows)))
    x = x.withColumn("_slice", F.floor((F.col("_h").cast("double") + float(1 << 63)) / (2.0 ** 64 / slices)).cast("int"))
    # keys without nulls: the window and the join after it share one partitioning
    key = ["_name", "_none", "_slice"]
    x = x.withColumn("_name", F.coalesce(F.col("src").cast("string"), F.lit(""))).withColumn("_none", F.col("src").isNull())
    per = x.groupBy(*key).agg(F.sum("size").alias("_sum"))
    w = Window.partitionBy("_name", "_none").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*key, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*key).orderBy("_h", "_id", "size")
    x = x.withColumn("_run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.join(start, key)
    return x.select("_id", "src", "size", (F.col("_start") + F.col("_run") - F.col("size")).alias("offset"),
                    *(["_row"] if keep else []))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             block_words: int = 2048, shards: int = 64, seed: int = 7) -> tuple[Plan, DataFrame]:
    """The plan and the table of sources (src, source_size, target).  One row
    per source passes the driver.  Blocks grow with the corpus so that there
    are at most ``MAX_BLOCKS`` of them, which the draws rely on."""
    sized = docs.select(F.col(source).alias("src"), word_count(text).alias("size"))
    targets = settled(source_targets(sized))
    rows = targets.orderBy(F.col("src").asc_nulls_last()).collect()
    total = sum(r["source_size"] for r in rows)
    block = max(block_words, -(-MAX_PASSES * total // MAX_BLOCKS))
    return Plan([(r["src"], r["source_size"], r["target"]) for r in rows], block, shards, seed), targets


def _pieces(plan: Plan, src: pd.Series, size: pd.Series, offset: pd.Series) -> dict[str, np.ndarray]:
    """The pieces taken of each row: row number, source number, epoch, rank
    of the block, and the words lo to hi (exclusive) of the document."""
    index = {name: i for i, name in enumerate(plan.names)}
    src = np.array([index[None if pd.isna(x) else x] for x in src], np.int64)
    off, size = offset.to_numpy(np.int64), size.to_numpy(np.int64)
    first, last = off // plan.block, (off + np.maximum(size, 1) - 1) // plan.block
    n = np.where(size > 0, last - first + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    block = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, block = np.tile(row, MAX_PASSES), np.tile(block, MAX_PASSES)
    epoch = np.repeat(np.arange(MAX_PASSES), n.sum())
    rank, words = plan.draw(src[row], block, epoch)
    lo = np.maximum(off[row], block * plan.block)
    hi = np.minimum(off[row] + size[row], block * plan.block + words)
    keep = hi > lo
    return {k: v[keep] for k, v in {"row": row, "src": src[row], "epoch": epoch, "rank": rank,
                                    "lo": lo - off[row], "hi": hi - off[row]}.items()}


def mix_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **plan_args) -> DataFrame:
    """(id, size, source_size, target, taken) for every row: its words, its
    source's words and target, and the words of it in the pieces that the
    shards are dealt, repeats counted (at most ``MAX_PASSES`` times its size).

    The pieces are dealt as in :func:`mix`, without their rows; a row with
    words is known by its source and offset.  Null texts have no words and
    take nothing; null is a source of its own; repeated rows count one by one;
    an empty table gives no rows."""
    plan, targets = plan_mix(docs, id_col, text, source, **plan_args)
    located = settled(_located(docs, id_col, text, source, plan.seed, keep=False))
    dealt = settled(_dealt(plan, located, ["src", "offset"]))
    words = dealt.groupBy(F.col("src").alias("_src"), F.col("offset").alias("_offset")).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    place = F.when(F.col("size") > 0, F.col("offset"))  # a row without words may share its offset
    got = located.join(words, F.col("src").eqNullSafe(F.col("_src")) & (place == F.col("_offset")), "left") \
        .select("_id", "src", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    t = targets.select(F.col("src").alias("_src"), "source_size", "target")
    return got.join(t, F.col("src").eqNullSafe(F.col("_src")), "left") \
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def _dealt(plan: Plan, located: DataFrame, columns: list[str]) -> DataFrame:
    """The drawn pieces of the rows of :func:`_located`: ``columns``, shard,
    place, epoch, lo, hi.  Partitions hold whole shards in their shuffled order."""
    starts = plan.shard_starts()

    @F.pandas_udf("array<struct<shard:long,place:long,epoch:long,lo:long,hi:long>>")
    def draw(src: pd.Series, size: pd.Series, offset: pd.Series) -> pd.Series:
        p = _pieces(plan, src, size, offset)
        shard = np.zeros(len(p["row"]), np.int64)
        for s in np.unique(p["src"]):
            at = p["src"] == s
            shard[at] = np.searchsorted(starts[:, s], p["rank"][at], side="right") - 1
        big = np.full(len(shard), 1 << 62, np.int64)
        place = permute(p["rank"], big, plan.key[p["src"]] ^ np.uint64(0x5851F42D4C957F2D))
        out: list[list[dict]] = [[] for _ in range(len(size))]
        for r, *piece in zip(*(x.tolist() for x in (p["row"], shard, place, p["epoch"], p["lo"], p["hi"]))):
            out[r].append(dict(zip(("shard", "place", "epoch", "lo", "hi"), piece)))
        return pd.Series(out)

    pieces = located.select(*columns, F.explode(draw("src", "size", "offset")).alias("p")).select(*columns, "p.*")
    return pieces.repartition(shuffle_width(located.sparkSession), "shard").sortWithinPartitions("shard", "place", "lo")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **plan_args) -> DataFrame:
    """The mixed pieces: all columns of ``docs`` as struct ``row``, ``shard``,
    ``place`` (order in the shard), ``epoch`` (pass through the source), and
    the words taken, ``lo`` to ``hi`` (exclusive) of ``size``.  Partitions
    hold whole shards in their shuffled order.  Rows without words are not
    drawn."""
    plan, _ = plan_mix(docs, id_col, text, source, **plan_args)
    located = _located(docs, id_col, text, source, plan.seed, keep=True).withColumnRenamed("_row", "row")
    return _dealt(plan, located, ["row", "size"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **plan_args) -> DataFrame:
    """The mix as documents: one row per piece with the columns of ``docs``;
    ``text`` (and ``n_chars``, where there is such a column) is that of the
    words taken, from the first word's first to the last word's last
    character; a document taken whole keeps its text as it is."""
    @F.pandas_udf("string")
    def cut(body: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([word_slice(b, x, y) for b, x, y in zip(body, lo, hi)], dtype=object)

    part = (F.col("lo") > 0) | (F.col("hi") < F.col("size"))
    taken = mix(docs, id_col, text, source, **plan_args) \
        .withColumn("_cut", cut(F.when(part, F.col(f"row.`{text}`")), "lo", "hi"))
    body = F.when(part, F.col("_cut")).otherwise(F.col(f"row.`{text}`"))
    columns = []
    for c in docs.columns:
        value = body if c == text else F.when(part, F.char_length("_cut")).otherwise(F.col("row.n_chars")).cast(
            docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")
        columns.append(value.alias(c))
    return taken.select(*columns)


_WORD = re.compile(WORD)


def word_slice(text: str | None, lo: int, hi: int) -> str | None:
    """Words lo to hi (exclusive) of a text with what stands between them."""
    if text is None:
        return None
    start = stop = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i == lo:
            start = m.start()
        if i == hi - 1:
            stop = m.end()
            break
    return text[start:stop]
