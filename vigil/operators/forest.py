"""Random forests of very many rows, grown over groups of equal bins (§2.9, §2.11)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTOGRAM_BYTES = 64 << 20  # of the trees that grow together, in one task
PURE = 2.0 ** -52


def grouped_forest(groups: DataFrame, numbers: Sequence[str], cuts: Sequence[Sequence[float]], rf: RandomForestClassifier,
                   per_task: int = 25_000) -> RandomForestClassificationModel:
    """The forest of the rows that stand behind ``groups``: ``_rows`` of them have
    the label and the bins (``numbers``, 0 up to the number of the feature's
    ``cuts``, its thresholds).  The trees, depth and seed are those of ``rf``.

    The bootstrap of a forest takes every row Poisson(1) times for every tree.
    Rows of a group count alike in a tree, so only their sum matters: it is one
    Poisson(``_rows``) draw, made for each group and tree from a seed of the
    group's values.  All trees grow a level a job by SparkML's rules (Gini gain,
    a random square root of the features a node, leaves of one prediction
    merged): tasks add up class weights by tree, node and bin, a tree's best
    splits are found in a task of its own, the driver sees the splits."""
    label, trees, depth, seed = rf.getLabelCol(), rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()
    y = F.col(label).cast("double")
    n, top, bad = groups.agg(F.count(F.lit(1)), F.max(y), F.count_if(F.coalesce(F.isnan(y) | (y < 0) | (y != F.floor(y)), F.lit(True)))).first()
    if not n or bad:
        raise ValueError(f"a forest needs rows, and the numbers 0, 1, ... as labels: {n} groups, {bad} of them with others")
    classes, width = int(top) + 1, max(len(c) for c in cuts) + 1
    together = max(1, HISTOGRAM_BYTES // (len(cuts) * 2 ** max(depth - 1, 0) * width * classes * 8))
    nodes: dict[tuple[int, int], tuple] = {}
    for start in range(0, trees, together):
        nodes.update(_grown(groups.coalesce(-(-n // per_task)), numbers, label, [len(c) for c in cuts], classes, depth, seed, trees,
                            range(start, min(start + together, trees))))
    return rf._copyValues(_model(groups.sparkSession, rf.uid, nodes, cuts, classes, trees))


def _grown(groups: DataFrame, numbers: Sequence[str], label: str, limits: Sequence[int], classes: int, depth: int, seed: int, trees: int,
           some: range) -> dict[tuple[int, int], tuple]:
    """(tree, node) -> (feature or -1 for a leaf, last bin to the left, gain or None where
    no split was looked for, class weights); children of node k are 2 k and 2 k + 1."""
    features, width = len(limits), max(limits) + 1
    taken = features if trees == 1 else math.ceil(math.sqrt(features))

    @F.pandas_udf("binary")
    def drawn(key: pd.Series, rows: pd.Series) -> pd.Series:
        bits = np.random.Philox(key=0)
        draw, state, out = np.random.Generator(bits), bits.state, []
        for k, r in zip(key.tolist(), rows):
            state["state"]["key"][0] = k % 2**64
            bits.state = state
            out.append(draw.poisson(r, trees)[some.start:some.stop].astype("<f8").tobytes())
        return pd.Series(out)
    rows = groups.select(*[F.col(c).cast("int").alias(f"b{i}") for i, c in enumerate(numbers)], F.col(label).cast("int").alias("y"),
                         drawn(F.xxhash64(*numbers, label, F.lit(seed)), "_rows").alias("draws")).persist()
    feature, last = (np.full((len(some), 2 ** depth), -1, dtype=np.int32) for _ in range(2))
    nodes: dict[tuple[int, int], tuple] = {}
    opened = np.zeros((len(some), 2), dtype=bool)
    opened[:, 1] = True
    try:
        for level in range(max(depth, 1)):
            first = 2 ** level
            here = opened[:, first:2 * first]

            def weights(batches):
                sums = np.zeros((len(some), features, first * width * classes))
                for b in batches:
                    table = np.stack([b.column(f"b{i}").to_numpy() for i in range(features)])
                    cells = table * classes + b.column("y").to_numpy()
                    draws = np.frombuffer(b"".join(b.column("draws").to_pylist()), "<f8").reshape(-1, len(some)).T
                    each = np.arange(table.shape[1])
                    for t in np.flatnonzero(here.any(axis=1)):
                        node = np.ones(len(each), dtype=np.int32)
                        for _ in range(level):
                            split = feature[t].take(node)
                            node = np.where(split >= 0, 2 * node + (table[split, each] > last[t].take(node)), 0)
                        node = np.maximum(node - first, -1)
                        counted = (node >= 0) & here[t].take(node)
                        w, start = np.where(counted, draws[t], 0.0), np.where(counted, node, 0) * (width * classes)
                        for f in range(features):
                            sums[t, f] += np.bincount(start + cells[f], weights=w, minlength=sums.shape[2])
                alive = np.flatnonzero(here.any(axis=1))
                yield pa.RecordBatch.from_pydict({"tree": pa.array(alive, pa.int32()), "sums": pa.array([sums[t].tobytes() for t in alive], pa.binary())})

            def best(key, parts):
                t = int(key[0].as_py())
                sums = np.zeros((features, first, width, classes))
                for s in parts.column("sums").to_pylist():
                    sums += np.frombuffer(s, "<f8").reshape(sums.shape)
                out = []
                for k in np.flatnonzero(here[t]).tolist():
                    looked = np.sort(np.random.default_rng([seed % 2**64, some.start + t, first + k]).choice(features, taken, replace=False))
                    f, cut, gain, left = _best(sums[looked, k], [limits[i] for i in looked])
                    out.append((t, first + k, int(looked[f]) if gain > 0 else -1, cut, gain, sums[0, k].sum(axis=0).tolist(), left.tolist()))
                names = ["tree", "node", "feature", "last", "gain", "total", "left"]
                return pa.table(dict(zip(names, map(list, zip(*out)))), schema=pa.schema(list(zip(names, (
                    pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))))))

            found = rows.mapInArrow(weights, "tree int, sums binary").groupBy("tree").applyInArrow(
                best, "tree int, node int, feature int, last int, gain double, total array<double>, left array<double>").collect()
            opened = np.zeros((len(some), 4 * first), dtype=bool)
            for r in found:
                t, k = r["tree"], r["node"]
                total, left = np.array(r["total"]), np.array(r["left"])
                split = depth > 0 and r["feature"] >= 0
                nodes[some.start + t, k] = (r["feature"] if split else -1, r["last"], r["gain"], total)
                if split:
                    feature[t, k], last[t, k] = r["feature"], r["last"]
                    for child, w in ((2 * k, left), (2 * k + 1, total - left)):
                        nodes[some.start + t, child] = (-1, -1, None, w)
                        opened[t, child] = level + 1 < depth and abs(float(_gini(w))) >= PURE
            if not opened.any():
                break
    finally:
        rows.unpersist()
    return nodes


def _gini(weights: np.ndarray) -> np.ndarray:
    """Of class weights along the last axis, 0 where there are none."""
    total = weights.sum(axis=-1)
    out = np.ones_like(total)
    for k in range(weights.shape[-1]):
        out -= (weights[..., k] / np.where(total > 0, total, 1)) ** 2
    return np.where(total > 0, out, 0.0)


def _best(sums: np.ndarray, limits: Sequence[int]) -> tuple[int, int, float, np.ndarray]:
    """Feature, last bin to the left, gain (at most 0 where nothing can be split) and
    class weights to the left of a node's best split, the first of equals;
    ``sums`` are its class weights by feature and bin."""
    total = sums[0].sum(axis=0)
    left = sums.cumsum(axis=1)[:, :-1]
    right = total - left
    n = total.sum()
    gain = _gini(total) - left.sum(axis=-1) / n * _gini(left) - right.sum(axis=-1) / n * _gini(right) if n else np.zeros(left.shape[:2])
    whole = (left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0) & (np.arange(left.shape[1]) < np.array(limits)[:, None])
    gain = np.where(whole, gain, -np.inf)
    if not np.isfinite(gain).any():
        return 0, -1, 0.0, np.zeros_like(total)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(cut), float(gain[f, cut]), left[f, cut]


def _model(spark, uid: str, nodes: dict[tuple[int, int], tuple], cuts: Sequence[Sequence[float]], classes: int, trees: int) -> RandomForestClassificationModel:
    """SparkML's model of the grown nodes."""
    sc = spark.sparkContext
    ml, gini = sc._jvm.org.apache.spark.ml, sc._jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator
    new_leaf, new_inner, new_split = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    new_tree, part = ml.classification.DecisionTreeClassificationModel, sc._jvm.java.util.Arrays.copyOfRange
    place = {key: i * classes for i, key in enumerate(nodes)}
    weights_of_all = _py2java(sc, DenseVector(np.concatenate([n[3] for n in nodes.values()]))).toArray()

    def built(t: int, k: int) -> tuple[object, float | None]:
        """The node, and its prediction if it is a leaf."""
        f, cut, gain, weights = nodes[t, k]
        predicted = float(weights.argmax())
        (left, a), (right, b) = (built(t, 2 * k), built(t, 2 * k + 1)) if f >= 0 else ((None, None), (None, None))
        kept = gini(part(weights_of_all, place[t, k], place[t, k] + classes), int(weights.sum()))
        impurity = float(_gini(weights))
        if f < 0 or (a is not None and a == b):
            return new_leaf(predicted, impurity if f >= 0 or gain is None or gain > 0 else -1.0, kept), predicted
        return new_inner(predicted, impurity, gain, left, right, new_split(f, float(cuts[f][cut])), kept), None
    made = sc._gateway.new_array(new_tree, trees)
    with ThreadPool(8) as pool:  # thousands of small calls
        for t, root in enumerate(pool.map(inheritable_thread_target(spark)(lambda t: built(t, 1)[0]), range(trees))):
            made[t] = new_tree(f"{uid}_{t}", root, len(cuts), classes)
    return RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(uid, made, len(cuts), classes))
