"""Embedding whitening by spectrum slicing.

Vectors become exact integer vectors; the distinct ones are the fit list.
Spark adds up their sums and, about an integer centre, their products, as
exact integers; so the covariance is right to the last bit of a double, in
whatever order tasks end.  The driver holds matrices of the dimension, never
rows.

The number of eigenvalues above a shift is the number of positive pivots of
the LDL' factorisation (Bunch-Kaufman) of the shifted covariance.  Bisection
on that count isolates the j-th eigenvalue, Rayleigh quotient iteration
finishes it, and a pair counts as found only if its value lies in the interval
that the counts isolated.  Equal eigenvalues, which no shift parts, get an
orthonormal basis by inverse iteration.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import settled

#: Entries are multiplied by this and rounded down.
SCALE = 256
COMPONENTS = 4
#: Eigenvalues below this share of the trace cannot be whitened.
LEAST_SHARE = 1e-12
_LIMB = 1 << 60
_LONG = 1 << 63


# --- symmetric matrices ---------------------------------------------------------

def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of
    LDL' with Bunch-Kaufman pivoting (blocks of one and two)."""
    a = matrix - shift * np.eye(len(matrix))
    alpha = (1 + 17 ** 0.5) / 8
    n, k, above = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        two = False
        below = np.abs(a[k + 1:, k])
        largest = below.max() if k < n - 1 else 0.0
        if max(largest, abs(a[k, k])) == 0:
            k += 1  # a pivot of zero is not positive
            continue
        if abs(a[k, k]) < alpha * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * largest ** 2:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            above += 1 if det < 0 else 2 * int(block.trace() > 0)
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            above += int(a[k, k] > 0)
            rest = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(rest, rest) / a[k, k]
            k += 1
    return above


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """The unit vector along (matrix - shift)^-1 v."""
    for _ in range(3):
        try:
            w = np.linalg.solve(matrix - shift * np.eye(len(v)), v)
            size = np.linalg.norm(w)
            if np.isfinite(size) and size:
                return w / size
        except np.linalg.LinAlgError:
            pass
        shift += 4 * np.finfo(float).eps * scale  # the shift is an eigenvalue
    return v


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns)
    of a positive semidefinite symmetric matrix."""
    n, eps = len(matrix), np.finfo(float).eps
    k = min(k, n)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0  # no eigenvalue is larger
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    counts = {scale * (1 + 8 * n * eps): 0, -scale * 8 * n * eps: n}  # shift -> eigenvalues above it
    narrow = 8 * eps * scale
    rng = np.random.default_rng(n)
    values, vectors = [], []

    def free(v: np.ndarray) -> np.ndarray:
        for u in vectors:
            v = v - (u @ v) * u
        size = np.linalg.norm(v)
        return v / size if size else v

    while len(values) < k:
        j = len(values) + 1
        lo = max(s for s, c in counts.items() if c >= j)
        hi = min(s for s, c in counts.items() if c < j)
        alone = counts[lo] == j and counts[hi] == j - 1
        if alone:  # one eigenvalue in (lo, hi]
            v = free(rng.standard_normal(n))
            for _ in range(3):
                v = free(_solved(matrix, (lo + hi) / 2, v, scale))
            for _ in range(12):
                value = float(v @ matrix @ v)
                if np.linalg.norm(matrix @ v - value * v) <= 16 * eps * scale:
                    break
                v = free(_solved(matrix, value, v, scale))
            value = float(v @ matrix @ v)
            if lo <= value <= hi and np.linalg.norm(matrix @ v - value * v) <= 64 * n * eps * scale:
                values.append(value)
                vectors.append(v)
                continue
        if hi - lo <= narrow:  # equal to the last bits: a basis of their space
            for _ in range(min(counts[lo], k) - len(values)):
                v = free(rng.standard_normal(n))
                for _ in range(6):
                    v = free(_solved(matrix, lo, v, scale))
                values.append(float(v @ matrix @ v))
                vectors.append(v)
            continue
        middle = (lo + hi) / 2
        counts[middle] = count_above(matrix, middle)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).T[:, order]


# --- integer vectors ------------------------------------------------------------

def whole_vectors(column: pa.ListArray, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * entry) as int64) for each length among
    the vectors that are not null and have only finite entries; what exceeds 64
    bits stays at the end of the range."""
    lengths = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), -1)
    starts = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(float)  # null entries: NaN
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        matrix = values[starts[rows, None] + np.arange(n)]
        fit = np.isfinite(matrix).all(axis=1)
        x = np.clip(np.floor(scale * matrix[fit]), -2.0 ** 63, np.nextafter(2.0 ** 63, 0))
        yield rows[fit], x.astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """One code a vector, the same for equal vectors: bytes an entry, then the
    entries without zeros at the end."""
    if not x.size:
        return [b"\1"] * len(x)
    last = np.where((x != 0).any(axis=1), x.shape[1] - np.argmax((x != 0)[:, ::-1], axis=1), 0)
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        body = np.ascontiguousarray(x[rows].astype(f"<i{w}"))
        for i, row in zip(rows.tolist(), body):
            out[i] = bytes([w]) + row[:last[i]].tobytes()
    return out


def unpacked(codes: list[bytes], d: int | None = None) -> Iterator[np.ndarray]:
    """Matrices of the vectors, padded with zeros to ``d`` entries if given."""
    groups = defaultdict(list)
    for code in codes:
        groups[code[0], len(code)].append(code)
    for (w, size), same in groups.items():
        x = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), size)[:, 1:]
        x = np.ascontiguousarray(x).view(f"<i{w}").astype(np.int64).reshape(len(same), (size - 1) // w)
        yield x if d is None else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    return x.sum(axis=0).astype(object) if _largest(x) * len(x) < _LONG else x.astype(object).sum(axis=0)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; doubles while every partial sum is exact in them."""
    top = _largest(x) if x.dtype != object else max(abs(v) for v in x.ravel())
    if top * top * len(x) < 1 << 53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in int64 where that is exact, else as Python integers."""
    if n * _largest(x) + max(map(abs, sums), default=0) < _LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


# --- fit ------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with column ``sums``; eigenvalues, shares of the
    trace and unit eigenvectors (rows), largest first."""
    n: int
    sums: list[int]
    values: list[float]
    shares: list[float]
    vectors: list[list[float]]

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows ``z`` = n * x - S."""
        u = np.array(self.vectors).reshape(len(self.values), len(self.sums))
        return (z / self.n).astype(float) @ (u / np.sqrt(np.array(self.values))[:, None]).T


def distinct_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(code): each distinct integer vector once."""
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for _, x in whole_vectors(batch.column(0)) for c in packed(x)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["code"])

    return vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(codes, "code binary").distinct()


def _cells(keys: list[tuple[int, int]], values: list[int]) -> pa.RecordBatch:
    """Integers of any size as two addends that fit a decimal of 38 digits."""
    parts = [divmod(int(v), _LIMB) for v in values]
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         *(pa.array([Decimal(p[side]) for p in parts], kind) for side in (0, 1))], names=["i", "j", "high", "low"])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of the cells: at most one row a cell reaches the driver."""
    total = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in total.collect()}


_CELLS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a list of distinct vectors (see
    :func:`distinct_vectors`).  The driver gets the sums and the products: a
    number for each pair of dimensions, whatever the rows.  Components whose
    eigenvalue is under a 10^-12 of the trace are left out; an empty list, and
    one vector alone, have none."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0, object), 0
        for batch in batches:
            for x in unpacked(batch.column(0).to_pylist()):
                n += len(x)
                s = exact_sums(x)
                size = max(len(s), len(total))
                total = np.pad(total, (0, size - len(total))) + np.pad(s, (0, size - len(s)))
        yield _cells([(-1, -1), *((i, -1) for i in range(len(total)))], [n, *total])

    found = _added(distinct.mapInArrow(sums, _CELLS))
    n = found.pop((-1, -1), 0)
    d = len(found)
    total = [found[i, -1] for i in range(d)]
    if not n or not d:
        return Whitening(n, total, [], [], [])
    centre = [s // n for s in total]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sum_of = np.zeros((d, d), object)
        for batch in batches:
            for x in unpacked(batch.column(0).to_pylist(), d):
                wide = _largest(x) + max(map(abs, centre)) >= _LONG
                y = x.astype(object) - np.array(centre, dtype=object) if wide else x - np.array(centre, dtype=np.int64)
                sum_of = sum_of + exact_products(y)
        keys = [(i, j) for i in range(d) for j in range(i, d)]
        yield _cells(keys, [sum_of[k] for k in keys])

    cell = _added(distinct.mapInArrow(products, _CELLS))
    left = [s - n * c for s, c in zip(total, centre)]  # n times the mean about the centre
    exact = {(i, j): n * v - left[i] * left[j] for (i, j), v in cell.items()}  # n^2 times the covariance
    matrix = np.zeros((d, d))
    for (i, j), v in exact.items():
        matrix[i, j] = matrix[j, i] = v / (n * n)  # division of integers rounds once
    trace = sum(exact[i, i] for i in range(d)) / (n * n)
    values, vectors = leading_pairs(matrix, components)
    good = [j for j, e in enumerate(values) if e > LEAST_SHARE * trace]
    return Whitening(n, total, [float(values[j]) for j in good], [float(values[j]) / trace for j in good],
                     [vectors[:, j].tolist() for j in good])


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened list's covariance minus the
    identity, measured over the list."""
    k, unit = len(model.values), 1 << 44
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in unpacked(batch.column(0).to_pylist(), len(model.sums)):
                w = model.project(centred(x, model.n, model.sums))
                one += w.sum(axis=0)
                two += w.T @ w
        keys = [(i, j) for i in range(k) for j in range(k)]
        yield _cells([*((i, -1) for i in range(k)), *keys], [round(float(v) * unit) for v in [*one, *(two[c] for c in keys)]])

    found = _added(distinct.mapInArrow(moments, _CELLS))
    mean = [found[i, -1] / unit / model.n for i in range(k)]
    return max(abs(found[i, j] / unit / model.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(k))


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of each row with a vector: ``deviation`` is
    the sum over dimensions of (n * x - S)^2 (null beyond 64 bits), ``whitened``
    one double a component.  Rows whose vector is null or has a null or not finite
    entry are dropped; a vector shorter than others reads as padded with
    zeros."""
    d = len(model.sums)
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1)):
                x = np.pad(x[:, :d], ((0, 0), (0, max(0, d - x.shape[1]))))
                z = centred(x, model.n, model.sums)
                w = model.project(z)
                if z.dtype != object and _largest(z) ** 2 * d < _LONG:
                    far = (z * z).sum(axis=1).tolist()
                else:
                    far = [v if v < _LONG else None for v in (z.astype(object) ** 2).sum(axis=1)] if d else [0] * len(z)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(far, pa.int64()), lists], names=schema.names)

    return vectors.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(place, schema)


def report(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for
    each row with a vector and each component: those of :func:`transform`,
    fitted on the table's distinct vectors.  Repeated rows come as often as
    they are, null ids too; a table without two distinct vectors gives no
    rows, as no component can be whitened."""
    distinct = settled(distinct_vectors(vectors, vector))
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    shares = F.array(*[F.lit(s) for s in model.shares]).cast("array<double>")
    return transform(vectors, model, id_col, vector) \
        .select(id_col, "deviation", F.posexplode("whitened").alias("component", "whitened")) \
        .select(id_col, (F.col("component") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                F.get(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
