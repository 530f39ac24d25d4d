"""Lineage graph: edge building and impact analysis (§2.10)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

#: Nodes of a level that are sent to every task of the edge table.
FRONTIER_ROWS = 100_000


def build_edges(*parts: DataFrame) -> DataFrame:
    """Union edge tables (src, dst, type) and drop repeats."""
    u = parts[0].select("src", "dst", "type")
    for p in parts[1:]:
        u = u.unionByName(p.select("src", "dst", "type"))
    return u.distinct()


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None,
              checkpoint_every: int = 4) -> DataFrame:
    """All nodes reachable from the seed nodes (column ``node``) with their
    minimum depth: a breadth-first fixpoint of joins, one per level.

    Each level joins the frontier with the edge table and anti-joins the
    visited set, so only new nodes move on.  A level is kept in the shared
    ``spark.checkpoint.dir`` (reliable, survives executor loss) as soon as it is
    found, so none is computed again for the levels after it; every few levels
    the visited set is gathered there too, to keep the plan short on deep
    graphs.  A frontier of up to ``FRONTIER_ROWS`` nodes goes to the edges, a larger
    one meets them in a shuffle.  The loop ends when the frontier is empty,
    or after ``max_depth`` levels where the caller gives one."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # the edge table is read once per level: keep it (recomputable on loss)
    e = edges.select(F.col("src" if direction == "down" else "dst").alias("_from"),
                     F.col("dst" if direction == "down" else "src").alias("node")).filter(F.col("_from").isNotNull()).persist()
    visited = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint(eager=True)
    n = frontier.count()
    for d in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        start = frontier.select(F.col("node").alias("_from"))
        nxt = e.join(F.broadcast(start) if n <= FRONTIER_ROWS else start, "_from").select("node").distinct()
        nxt = nxt.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)).checkpoint(eager=True)
        n = nxt.count()
        if not n:
            break
        visited = visited.unionByName(nxt)
        if d % checkpoint_every == 0:
            visited = visited.checkpoint(eager=True)
        frontier = nxt
    e.unpersist()
    return visited


def key_edges(child: DataFrame, child_label: str, child_id: Sequence[str], parent_label: str,
              parent_key: str, edge_type: str) -> DataFrame:
    """Edges parent → child from a foreign key column: ``label:key`` ids."""
    cid = F.concat_ws(":", F.lit(child_label), *[F.col(c).cast("string") for c in child_id])
    return child.select(F.concat(F.lit(parent_label + ":"), F.col(parent_key).cast("string")).alias("src"),
                        cid.alias("dst"), F.lit(edge_type).alias("type"))
