"""Drift detectors and statistical tests (§2.9).

Reference and current frames are unpivoted into one long frame
``(keys..., feature, side, value)`` (side 0 = reference, 1 = current);
every test is then a grouped aggregate over it, so many features and
segments (``keys``) run in the same job.  Missing values are dropped per
feature, as the reference does.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.core import cell, cumulative, is_string, long_form, materialised, rnd, safe_div

# Default thresholds by method (p-value for ks/chi2, score otherwise)
DEFAULT_THRESHOLDS = {"ks": 0.05, "psi": 0.1, "mmd": 0.05, "classifier": 0.7, "chi2": 0.05, "table": 0.1}
PSI_FLOOR = 1e-4
N_BINS = 10
#: (segment, feature) ranges that are sent to every task; more of them are joined by shuffle.
BROADCAST_CELLS = 100_000


def sides(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, side, value) with missing values dropped."""
    r = long_form(ref, features, keys).withColumn("side", F.lit(0))
    c = long_form(cur, features, keys).withColumn("side", F.lit(1))
    u = r.unionByName(c)
    return u.filter(F.col("value").isNotNull() & ~F.isnan("value"))


# ------------------------------------------------------------------ KS
def kolmogorov_sf(lam: Column, terms: int = 12) -> Column:
    """Upper tail of the Kolmogorov distribution.

    2 Σ_{k≥1} (−1)^{k−1} exp(−2k²λ²) converges fast for large λ and not at
    all towards 0; its dual 1 − √(2π)/λ Σ_{k≥1} exp(−(2k−1)²π²/(8λ²)) does the
    opposite.  Either side of λ = 1.18 the 12th term is below 1e-100 of the
    first, so the sums are exact in double precision."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    tail = 2 * F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    x = F.try_divide(F.lit(math.pi ** 2 / 8), lam * lam)
    body = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(-(2 * k - 1) * (2 * k - 1) * x))
    small = 1 - F.try_divide(F.lit(math.sqrt(2 * math.pi)), lam) * body
    p = F.when(lam >= 1.18, tail).otherwise(F.coalesce(small, F.lit(1.0)))
    return F.when(lam.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def _value_pairs(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: list) -> DataFrame:
    """(keys, feature, value, nr, nc): rows of either side with each distinct
    value; repeated values combine before the shuffle."""
    return sides(ref, cur, features, keys).groupBy(*keys, "feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("nr"), F.count_if(F.col("side") == 1).alias("nc"))


def ks_test(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
            threshold: float = DEFAULT_THRESHOLDS["ks"], ranges: int | None = None) -> DataFrame:
    """Two-sample KS per (keys, feature): statistic = max |F_ref − F_cur|
    over the merged distinct values; asymptotic p-value with Stephens'
    small-sample correction; drifted when p < threshold.

    Values are counted per (feature, value) and ranked in ranges
    (:func:`cumulative`, as many as the data's size asks for), which gives both
    distribution functions at every value; the maximum is one aggregate.  Null keys are
    a segment like any other.  A (keys, feature) with rows on one side only has
    no statistic (null) and is not drifted."""
    keys = list(keys)
    jk = keys + ["feature"]
    cum = cumulative(_value_pairs(ref, cur, features, keys), jk, "value", ["nr", "nc"], ranges)
    gap = F.abs(F.try_divide("cum_nr", "tot_nr") - F.try_divide("cum_nc", "tot_nc"))  # null when a side is empty
    d = cum.groupBy(*jk).agg(F.first("tot_nr").alias("n_ref"), F.first("tot_nc").alias("n_cur"), F.max(gap).alias("statistic"))
    en = F.try_divide(F.col("n_ref") * F.col("n_cur"), F.col("n_ref") + F.col("n_cur"))
    lam = (F.sqrt(en) + 0.12 + F.try_divide(F.lit(0.11), F.sqrt(en))) * F.col("statistic")
    out = d.select(*jk, F.col("n_ref").cast("long"), F.col("n_cur").cast("long"),
                   rnd(F.col("statistic")).alias("statistic"), rnd(kolmogorov_sf(lam), 6).alias("p_value"))
    return out.withColumn("drifted", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


# ------------------------------------------------------------- histograms
def bin_counts(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
               n_bins: int = N_BINS) -> DataFrame:
    """Equal-width bins over the joint [min, max] of both sides (last bin
    closed, as ``np.histogram``), joined to a full bin spine so that bins
    empty on one or both sides are present.  Columns: keys, feature, bin,
    nr, nc, n_ref, n_cur, constant."""
    keys = list(keys)
    jk = keys + ["feature"]
    lf = sides(ref, cur, features, keys)
    rng = lf.groupBy(*jk).agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                              F.count_if(F.col("side") == 0).alias("n_ref"),
                              F.count_if(F.col("side") == 1).alias("n_cur"))
    b = F.least(F.floor(F.lit(float(n_bins)) * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))),
                F.lit(n_bins - 1)).cast("int")
    # one row per (segment, feature), computed once and counted: the engine takes
    # it to be as large as the rows it came from, and a shuffle by a few cells
    # would put all rows of a feature into one task
    rng = materialised(rng.withColumn("_cell", cell(jk)))
    bounds = rng.select("_cell", "lo", "hi")
    if rng.count() <= BROADCAST_CELLS:
        bounds = F.broadcast(bounds)
    binned = lf.withColumn("_cell", cell(jk)).join(bounds, "_cell") \
        .withColumn("bin", F.when(F.col("hi") > F.col("lo"), b).otherwise(F.lit(0)))
    h = binned.groupBy("_cell", "bin").agg(F.count_if(F.col("side") == 0).alias("nr"),
                                           F.count_if(F.col("side") == 1).alias("nc"))
    spine = rng.select(*jk, "_cell", "n_ref", "n_cur", (F.col("hi") == F.col("lo")).alias("constant"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return spine.join(h, ["_cell", "bin"], "left").select(
        *jk, "bin", F.coalesce("nr", F.lit(0)).alias("nr"), F.coalesce("nc", F.lit(0)).alias("nc"),
        "n_ref", "n_cur", "constant")


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
        threshold: float = DEFAULT_THRESHOLDS["psi"], n_bins: int = N_BINS) -> DataFrame:
    """Population stability index per (keys, feature): 10 equal-width bins of
    a numeric feature, one bin per value of a string feature; zero shares
    floored at 1e-4; a constant feature scores 0."""
    return _divergence(_any_cells(ref, cur, features, keys, n_bins), keys, "psi", threshold)


def kl_divergence(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
                  threshold: float = DEFAULT_THRESHOLDS["psi"], n_bins: int = N_BINS) -> DataFrame:
    """KL(current ‖ reference) on the PSI histogram."""
    return _divergence(_any_cells(ref, cur, features, keys, n_bins), keys, "kl", threshold)


def _any_cells(ref, cur, features, keys, n_bins) -> DataFrame:
    """Cells of numeric features by bin and of string features by value."""
    text = [f for f in features if is_string(ref, f)]
    numeric = [f for f in features if f not in text]
    cols = [*keys, "feature", "nr", "nc", "n_ref", "n_cur", "constant"]
    parts = [bin_counts(ref, cur, numeric, keys, n_bins).select(*cols)] if numeric else []
    if text:
        c = category_cells(ref, cur, text, keys).alias("c")
        t = category_cells(ref, cur, text, keys).groupBy(*keys, "feature").agg(
            F.sum("nr").alias("n_ref"), F.sum("nc").alias("n_cur"), (F.count(F.lit(1)) == 1).alias("constant")).alias("t")
        on = F.lit(True)
        for k in [*keys, "feature"]:
            on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
        parts.append(c.join(t, on).select(*[F.col(f"c.{k}") for k in [*keys, "feature"]], "nr", "nc", "n_ref", "n_cur", "constant"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _divergence(h: DataFrame, keys, kind, threshold) -> DataFrame:
    jk = list(keys) + ["feature"]
    # rows on one side only: no shares, no divergence (null), not drifted
    p = F.try_divide("nr", "n_ref")
    q = F.try_divide("nc", "n_cur")
    p = F.when(p == 0, PSI_FLOOR).otherwise(p)
    q = F.when(q == 0, PSI_FLOOR).otherwise(q)
    term = (q - p) * F.log(q / p) if kind == "psi" else q * F.log(q / p)
    out = h.groupBy(*jk).agg(F.sum(term).alias("_s"), F.first("constant").alias("_c"))
    val = F.when(F.col("_c") & F.col("_s").isNotNull(), F.lit(0.0)).otherwise(F.col("_s"))
    return out.select(*jk, rnd(val).alias(kind)).withColumn("drifted", F.coalesce(F.col(kind) > threshold, F.lit(False)))


# ------------------------------------------------------------------ chi2
def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: Q(dof/2, x/2) by series or
    continued fraction; from 20,000 degrees on by the Wilson–Hilferty cube
    root (error below 1e-5 there)."""
    if x is None or dof is None or dof <= 0 or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    if dof >= 20_000:
        v = 2.0 / (9.0 * dof)
        return 0.5 * math.erfc(((x / dof) ** (1 / 3) - 1 + v) / math.sqrt(2 * v))
    a, z = dof / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1:
        term = s = 1.0 / a
        ap = a
        while True:  # terms fall geometrically once ap > z
            ap += 1
            term *= z / ap
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - gln))
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return min(1.0, math.exp(-z + a * math.log(z) - gln) * h)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), int(d)) if pd.notna(s) and pd.notna(d) else np.nan
                      for s, d in zip(stat, dof)])


def chi2_from_cells(cells: DataFrame, group: Sequence[str], threshold: float = DEFAULT_THRESHOLDS["chi2"]) -> DataFrame:
    """χ² test of homogeneity of a 2 x k table given as rows (group..., nr,
    nc) per cell.  Cells empty on both sides are dropped; dof = used − 1;
    Yates' correction when dof = 1 (as SciPy)."""
    g = list(group)
    used = cells.filter((F.col("nr") + F.col("nc")) > 0)
    tot = used.groupBy(*g).agg(F.sum("nr").alias("R"), F.sum("nc").alias("C"), F.count(F.lit(1)).alias("k"))
    # one row per test group; AQE broadcasts it when it is measured small
    j = used.join(tot, g)
    n = F.col("R") + F.col("C")
    col = F.col("nr") + F.col("nc")
    er, ec = F.col("R") * col / n, F.col("C") * col / n
    dof = F.col("k") - 1

    def cell(o, e):
        dev = F.abs(o - e)
        dev = F.when(dof == 1, F.greatest(dev - 0.5, F.lit(0.0))).otherwise(dev)
        return F.when(e > 0, dev * dev / e).otherwise(F.lit(0.0))
    s = j.groupBy(*g, "k").agg(F.sum(cell(F.col("nr"), er) + cell(F.col("nc"), ec)).alias("_x"))
    out = s.select(*g, rnd(F.col("_x")).alias("statistic"), (F.col("k") - 1).cast("long").alias("dof"))
    out = out.withColumn("p_value", F.when(F.col("dof") > 0, F.round(chi2_pvalue(F.col("statistic"), F.col("dof")), 6))
                         .otherwise(F.lit(1.0)))
    return out.withColumn("drifted", F.col("p_value") < threshold)


def chi2_test(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
              threshold: float = DEFAULT_THRESHOLDS["chi2"], n_bins: int = N_BINS) -> DataFrame:
    """χ² on the 10-bin contingency of numeric features."""
    h = bin_counts(ref, cur, features, keys, n_bins)
    return chi2_from_cells(h.select(*keys, "feature", "bin", "nr", "nc"), list(keys) + ["feature"], threshold)


def category_cells(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One cell per category value for categorical features (D12)."""
    r = long_form(ref, features, keys, cast="string").withColumn("side", F.lit(0))
    c = long_form(cur, features, keys, cast="string").withColumn("side", F.lit(1))
    u = r.unionByName(c).filter(F.col("value").isNotNull())
    return u.groupBy(*keys, "feature", "value").agg(F.count_if(F.col("side") == 0).alias("nr"),
                                                    F.count_if(F.col("side") == 1).alias("nc"))


# ------------------------------------------------------------------ CvM
def cvm_test(ref: DataFrame, cur: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
             ranges: int | None = None) -> DataFrame:
    """Two-sample Cramér–von Mises statistic in the ECDF form
    T = NM/(N+M)² Σ_pooled (F_N − G_M)² (equals the rank form without ties),
    from the same merged cumulative counts as KS; null when a side is empty."""
    keys = list(keys)
    jk = keys + ["feature"]
    cum = cumulative(_value_pairs(ref, cur, features, keys), jk, "value", ["nr", "nc"], ranges) \
        .withColumnsRenamed({"tot_nr": "N", "tot_nc": "M"})
    diff = F.try_divide("cum_nr", "N") - F.try_divide("cum_nc", "M")
    s = cum.groupBy(*jk, "N", "M").agg(F.sum((F.col("nr") + F.col("nc")) * diff * diff).alias("_s"))
    t = F.col("N") * F.col("M") / F.pow(F.col("N") + F.col("M"), 2) * F.col("_s")
    return s.select(*jk, F.col("N").cast("long").alias("n_ref"), F.col("M").cast("long").alias("n_cur"), rnd(t).alias("statistic"))


# ------------------------------------------------------------ reference
def reference_snapshot(df: DataFrame, ts: str, as_of: Column, days: int, path: str,
                       snapshot_col: str = "snapshot_date") -> None:
    """Keep the rolling reference window [as_of − days, as_of) as a snapshot
    partition, one per refresh date: a second refresh of the day replaces the
    first, other days stay."""
    win = df.filter((F.col(ts) >= F.timestamp_add("DAY", F.lit(-days), as_of)) & (F.col(ts) < as_of))
    win.withColumn(snapshot_col, F.to_date(as_of)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(snapshot_col).parquet(path)


def latest_reference(spark, path: str, snapshot_col: str = "snapshot_date") -> DataFrame:
    """The newest stored reference snapshot (partition pruning on the
    snapshot column)."""
    snaps = spark.read.parquet(path)
    last = snaps.agg(F.max(snapshot_col).alias("_m"))
    return snaps.join(last, snaps[snapshot_col] == last["_m"], "left_semi").drop(snapshot_col)


# ------------------------------------------------------------- summaries
def severity(score: Column, threshold: Column | float) -> Column:
    """none / low / medium / high / critical at 1, 1.5, 2, 3 x threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (F.when(score <= t, "none").when(score <= t * 1.5, "low").when(score <= t * 2.0, "medium")
            .when(score <= t * 3.0, "high").otherwise("critical"))


def pvalue_severity(p: Column, threshold: float) -> Column:
    """Severity for p-value tests from the ratio threshold / p (D11)."""
    ratio = F.when(p > 0, F.lit(threshold) / p).otherwise(F.lit(1e9))
    return severity(ratio, 1.0)


def dataset_drift(per_feature: DataFrame, score_col: str, method: str, threshold: float | None = None,
                  keys: Sequence[str] = (), p_col: str | None = None, legacy: bool = False) -> DataFrame:
    """Run-level result: score = mean per-feature statistic; drifted if
    min p < thr (p-value tests) or mean score > thr; drifted feature list
    (sorted), severity, and advice text (first 5 features + count).

    Severity of p-value tests comes from threshold / p (D11); with
    ``legacy=True`` it compares the mean statistic with the p-value
    threshold instead, as the surveyed code does."""
    thr = DEFAULT_THRESHOLDS[method] if threshold is None else threshold
    agg = per_feature.groupBy(*keys).agg(
        F.avg(score_col).alias("_score"), F.count(F.lit(1)).cast("long").alias("n_features"),
        F.count_if("drifted").cast("long").alias("n_drifted"),
        F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("_feats"),
        *([F.min(p_col).alias("_p")] if p_col else []))
    drifted = (F.col("_p") < thr) if p_col else (F.col("_score") > thr)
    sev = pvalue_severity(F.col("_p"), thr) if (p_col and not legacy) else severity(F.col("_score"), thr)
    out = agg.select(*keys, F.lit(method).alias("method"), rnd(F.col("_score")).alias("score"),
                     *([rnd(F.col("_p"), 6).alias("p_value")] if p_col else []),
                     F.coalesce(drifted, F.lit(False)).alias("is_drifted"), "n_features", "n_drifted",
                     F.concat_ws(",", "_feats").alias("features_drifted"),
                     F.when(F.coalesce(drifted, F.lit(False)), sev).otherwise("none").alias("severity"))
    return out.withColumn("recommendation", recommendation_text(F.col("is_drifted"), F.col("severity"),
                                                                F.split(F.col("features_drifted"), ",")))


def recommendation_text(drifted: Column, sev: Column, feats: Column) -> Column:
    feats = F.filter(feats, lambda x: x != "")
    first5 = F.concat_ws(", ", F.slice(feats, 1, 5))
    more = F.when(F.size(feats) > 5, F.format_string(" and %d features in all", F.size(feats))).otherwise("")
    parts = F.array(
        F.lit("drift detected, re-evaluate model performance"),
        F.when(sev.isin("high", "critical"), F.lit("severe drift, retrain the model now")),
        F.when(F.size(feats) > 0, F.concat(F.lit("drifted features: "), first5, more)))
    return F.when(drifted, F.concat_ws("; ", parts)).otherwise(F.lit(""))


def feature_rank(per_feature: DataFrame, stat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Attribution: rank features by statistic (largest first; name breaks
    ties).  The input has one row per feature, so the window is small."""
    w = Window.partitionBy(*keys).orderBy(F.col(stat).desc(), F.col("feature"))
    return per_feature.withColumn("rank", F.row_number().over(w).cast("long"))


# ---------------------------------------------------------------- others
def embedding_drift(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Cosine distance between the mean embeddings of both sides."""
    def means(df, side):
        e = df.select(F.posexplode(col).alias("i", "x"))
        return e.groupBy("i").agg(F.avg("x").alias(f"m{side}"), F.count(F.lit(1)).alias(f"n{side}"))
    j = means(ref, 0).join(means(cur, 1), "i", "full_outer")
    a, b = F.coalesce(F.col("m0"), F.lit(0.0)), F.coalesce(F.col("m1"), F.lit(0.0))
    s = j.agg(F.sum(a * b).alias("dot"), F.sum(a * a).alias("na"), F.sum(b * b).alias("nb"),
              F.count(F.lit(1)).cast("long").alias("dims"))
    cos = F.col("dot") / (F.sqrt("na") * F.sqrt("nb"))
    return s.select("dims", rnd(cos, 6).alias("cosine_similarity"), rnd(1 - cos, 6).alias("cosine_distance"))


def correlation_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """|corr_ref(a,b) − corr_cur(a,b)| for all feature pairs, both sides in
    one aggregate each."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]

    def corrs(df):
        return df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    r, c = corrs(ref), corrs(cur)
    st_r = r.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                 F.col(f"{a}__{b}").alias("corr_ref")) for a, b in pairs])).alias("s")).select("s.*")
    st_c = c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                 F.col(f"{a}__{b}").alias("corr_cur")) for a, b in pairs])).alias("s")).select("s.*")
    j = st_r.join(st_c, ["a", "b"])
    return j.select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), rnd(F.col("corr_ref")).alias("corr_ref"),
                    rnd(F.col("corr_cur")).alias("corr_cur"), rnd(F.abs(F.col("corr_ref") - F.col("corr_cur"))).alias("abs_diff"))


def rff_mmd(ref: DataFrame, cur: DataFrame, col: str, gamma: float | None = None, n_features: int = 2048,
            seed: int = 42) -> DataFrame:
    """Biased RBF-kernel MMD² estimated with random Fourier features
    (Rahimi & Recht): MMD² ≈ ‖mean φ(ref) − mean φ(cur)‖², φ(x) =
    √(2/D)·cos(Wx + b), W ~ N(0, 2γI).  Linear in the rows: each task maps
    its Arrow batches with NumPy and emits per-side partial sums, which
    Spark aggregates.  No pairs of rows are formed."""
    spark = ref.sparkSession
    ref, cur = ref.filter(F.col(col).isNotNull()), cur.filter(F.col(col).isNotNull())
    first = ref.select(col).head() or cur.select(col).head()
    dim = len(first[0]) if first else 1
    g = 1.0 / dim if gamma is None else gamma
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * g), size=(n_features, dim))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    bw = spark.sparkContext.broadcast((W, b))
    D = n_features

    def part(it):
        W_, b_ = bw.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            for side, grp in pdf.groupby("side"):
                X = np.stack(grp[col].to_numpy()).astype(np.float64)
                phi = np.sqrt(2.0 / D) * np.cos(X @ W_.T + b_)
                yield pd.DataFrame({"side": int(side), "k": np.arange(D, dtype=np.int64),
                                    "s": phi.sum(axis=0), "n": np.int64(len(X))})
    u = ref.select(col, F.lit(0).alias("side")).unionByName(cur.select(col, F.lit(1).alias("side")))
    sums = u.mapInPandas(part, "side int, k long, s double, n long")
    per = sums.groupBy("side", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    m = per.groupBy("k").agg(F.sum(F.when(F.col("side") == 0, F.col("s") / F.col("n"))).alias("m0"),
                             F.sum(F.when(F.col("side") == 1, F.col("s") / F.col("n"))).alias("m1"))
    return m.agg(F.sum(F.pow(F.coalesce("m0", F.lit(0.0)) - F.coalesce("m1", F.lit(0.0)), 2)).alias("mmd2")) \
        .select(rnd(F.col("mmd2"), 6).alias("mmd2"), (F.col("mmd2") > DEFAULT_THRESHOLDS["mmd"]).alias("is_drifted"))


def concept_z(history: DataFrame, current: DataFrame, key: str, value: str, z_thr: float = 2.5) -> DataFrame:
    """z = (current − mean(history)) / std(history, ddof 1); flag |z| > 2.5."""
    h = history.groupBy(key).agg(F.avg(value).alias("mean_hist"), F.stddev_samp(value).alias("std_hist"),
                                 F.count(F.lit(1)).cast("long").alias("n_hist"))
    j = current.select(key, F.col(value).alias("current")).join(h, key)
    z = safe_div(F.col("current") - F.col("mean_hist"), F.col("std_hist"))
    return j.select(key, rnd(F.col("current")).alias("current"), rnd(F.col("mean_hist")).alias("mean_hist"),
                    rnd(F.col("std_hist")).alias("std_hist"), "n_hist", rnd(z, 6).alias("z"),
                    F.coalesce(F.abs(z) > z_thr, F.lit(False)).alias("drifted"))


def page_hinkley(series: DataFrame, key: str, order: str, value: str, delta: float = 0.005,
                 lam: float = 50.0) -> DataFrame:
    """Page–Hinkley change test per series: m_t = Σ(x_i − x̄_i − δ),
    PH_t = m_t − min_{s≤t} m_s; change when PH_t > λ.  Windows are per
    series key (one row per period)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("_mean", F.avg(value).over(w)).withColumn("_d", F.col(value) - F.col("_mean") - delta)
    s = s.withColumn("m", F.sum("_d").over(w))
    s = s.withColumn("ph", F.col("m") - F.least(F.min("m").over(w), F.lit(0.0)))
    return s.select(key, order, rnd(F.col(value)).alias(value), rnd(F.col("m"), 6).alias("m"),
                    rnd(F.col("ph"), 6).alias("ph"), (F.col("ph") > lam).alias("change"))


def prediction_drift(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """KS on predictions plus mean and population std on both sides."""
    k = ks_test(ref, cur, [col])
    st_r = ref.agg(F.avg(col).alias("ref_mean"), F.stddev_pop(col).alias("ref_std"))
    st_c = cur.agg(F.avg(col).alias("cur_mean"), F.stddev_pop(col).alias("cur_std"))
    j = k.withColumn("_k", F.lit(1)).join(st_r.withColumn("_k", F.lit(1)), "_k") \
        .join(st_c.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j.select("feature", "statistic", "p_value", "drifted", rnd(F.col("ref_mean")).alias("ref_mean"),
                    rnd(F.col("ref_std")).alias("ref_std"), rnd(F.col("cur_mean")).alias("cur_mean"),
                    rnd(F.col("cur_std")).alias("cur_std"))
