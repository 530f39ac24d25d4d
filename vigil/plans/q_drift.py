"""§2.9 drift queries.  Splits: events at 2024-01-16 (reference before),
lineitem at ship date 1998-01-01, documents by language (en = reference),
embeddings by label (0–4 reference, 5–9 current)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import drift as dr
from vigil.plans.fixtures import DRIFT_RUNS_SQL, drift_runs
from vigil.plans.registry import query
from vigil.sources.readers import table

EV_SPLIT = "2024-01-16"
LI_SPLIT = "1998-01-01"
EV_FEATS = ["value", "user_id"]
LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def ev_halves(spark, sf, cols=None):
    ev = table(spark, sf, "events", (cols or EV_FEATS) + ["ts"])
    return (ev.filter(F.col("ts") < ts_lit(EV_SPLIT)).drop("ts"),
            ev.filter(F.col("ts") >= ts_lit(EV_SPLIT)).drop("ts"))


def li_halves(spark, sf, cols=None):
    li = table(spark, sf, "lineitem", (cols or LI_FEATS) + ["l_shipdate"])
    return (li.filter(F.col("l_shipdate") < ts_lit(LI_SPLIT)).drop("l_shipdate"),
            li.filter(F.col("l_shipdate") >= ts_lit(LI_SPLIT)).drop("l_shipdate"))


def lf_sql(tbl, feats, ts, split, keys=""):
    k = f"{keys}, " if keys else ""
    parts = []
    for f in feats:
        parts.append(f"SELECT {k}'{f}' AS feature, 0 AS side, CAST({f} AS DOUBLE) AS value FROM {tbl} WHERE {ts} < TIMESTAMP '{split}'")
        parts.append(f"SELECT {k}'{f}' AS feature, 1 AS side, CAST({f} AS DOUBLE) AS value FROM {tbl} WHERE {ts} >= TIMESTAMP '{split}'")
    return "lf AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL AND NOT isnan(value))"


def ks_sql(lf, keys=""):
    k = f"{keys}, " if keys else ""
    pk = f"PARTITION BY {keys}, feature" if keys else "PARTITION BY feature"
    return f"""WITH {lf},
c AS (SELECT {k}feature, value, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc
      FROM lf GROUP BY ALL),
t AS (SELECT {k}feature, sum(nr) AS n_ref, sum(nc) AS n_cur FROM c GROUP BY ALL),
cu AS (SELECT {k}feature, value, sum(nr) OVER ({pk} ORDER BY value) AS cr, sum(nc) OVER ({pk} ORDER BY value) AS cc FROM c),
d AS (SELECT {k}cu.feature, n_ref, n_cur, max(abs(cr / n_ref - cc / n_cur)) AS stat
      FROM cu JOIN t USING ({k}feature) GROUP BY ALL),
e AS (SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur))) * stat AS lam FROM d),
p AS (SELECT *, CASE WHEN lam = 0 THEN 1.0
        WHEN lam < 1 THEN greatest(0.0, 1 - sqrt(2 * pi()) / lam * (SELECT sum(exp(-pow((2 * j + 1) * pi() / lam, 2) / 8)) FROM range(0, 40) r(j)))
        ELSE least(1.0, 2 * (SELECT sum(exp(-2 * pow((2 * j + 1) * lam, 2)) - exp(-2 * pow((2 * j + 2) * lam, 2))) FROM range(0, 40) r(j))) END AS pv FROM e)
SELECT {k}feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, round(stat, 9) AS statistic,
       round(pv, 6) AS p_value, round(pv, 6) < 0.05 AS drifted FROM p"""


def hist_sql(lf, keys=""):
    k = f"{keys}, " if keys else ""
    return f"""{lf},
rng AS (SELECT {k}feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 0) AS n_ref,
        count(*) FILTER (WHERE side = 1) AS n_cur FROM lf GROUP BY ALL),
b AS (SELECT {k}lf.feature, side, CASE WHEN hi > lo THEN CAST(least(floor(CAST(10 AS DOUBLE) * (value - lo) / (hi - lo)), 9) AS INTEGER) ELSE 0 END AS bin
      FROM lf JOIN rng USING ({k}feature)),
h AS (SELECT {k}feature, bin, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM b GROUP BY ALL),
sp AS (SELECT {k}feature, n_ref, n_cur, hi = lo AS constant, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM rng),
hj AS (SELECT sp.*, coalesce(h.nr, 0) AS nr, coalesce(h.nc, 0) AS nc FROM sp LEFT JOIN h USING ({k}feature, bin)),
x AS (SELECT *, CASE WHEN CAST(nr AS DOUBLE) / n_ref = 0 THEN 1e-4 ELSE CAST(nr AS DOUBLE) / n_ref END AS p,
               CASE WHEN CAST(nc AS DOUBLE) / n_cur = 0 THEN 1e-4 ELSE CAST(nc AS DOUBLE) / n_cur END AS q FROM hj)"""


def psi_sql(lf, keys="", kind="psi", thr=0.1):
    k = f"{keys}, " if keys else ""
    term = "(q - p) * ln(q / p)" if kind == "psi" else "q * ln(q / p)"
    return f"""WITH {hist_sql(lf, keys)}
SELECT {k}feature, round(CASE WHEN bool_or(constant) THEN 0.0 ELSE sum({term}) END, 9) AS {kind},
       round(CASE WHEN bool_or(constant) THEN 0.0 ELSE sum({term}) END, 9) > {thr} AS drifted
FROM x GROUP BY ALL"""


EV_LF = lf_sql("events", EV_FEATS, "ts", EV_SPLIT)
LI_LF = lf_sql("lineitem", LI_FEATS, "l_shipdate", LI_SPLIT)


@query("drift_ks", ks_sql(EV_LF))
def q_drift_ks(spark, sf):
    r, c = ev_halves(spark, sf)
    return dr.ks_test(r, c, EV_FEATS)


@query("drift_psi", psi_sql(LI_LF))
def q_drift_psi(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.psi(r, c, LI_FEATS)


@query("drift_psi_category", """WITH s AS (SELECT feature, v, side FROM (
  SELECT 'o_orderstatus' AS feature, o_orderstatus AS v, (o_orderdate >= TIMESTAMP '1998-01-01')::INT AS side FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, (o_orderdate >= TIMESTAMP '1998-01-01')::INT FROM orders) WHERE v IS NOT NULL),
n AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS nr_all, count(*) FILTER (WHERE side = 1) AS nc_all, count(DISTINCT v) = 1 AS one FROM s GROUP BY feature),
c AS (SELECT feature, v, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM s GROUP BY ALL),
x AS (SELECT c.feature, one, CASE WHEN nr_all > 0 THEN greatest(CAST(nr AS DOUBLE) / nr_all, CASE WHEN nr = 0 THEN 1e-4 ELSE 0 END) END AS p,
  CASE WHEN nc_all > 0 THEN greatest(CAST(nc AS DOUBLE) / nc_all, CASE WHEN nc = 0 THEN 1e-4 ELSE 0 END) END AS q FROM c JOIN n USING (feature)),
y AS (SELECT feature, CASE WHEN bool_or(one) THEN 0.0 ELSE sum((q - p) * ln(q / p)) END AS d FROM x GROUP BY feature)
SELECT feature, round(d, 9) AS psi, coalesce(round(d, 9) > 0.1, FALSE) AS drifted FROM y""")
def q_drift_psi_category(spark, sf):
    o = table(spark, sf, "orders", ["o_orderdate", "o_orderstatus", "o_orderpriority"])
    late = F.col("o_orderdate") >= ts_lit("1998-01-01")
    return dr.psi(o.filter(~late), o.filter(late), ["o_orderstatus", "o_orderpriority"])


@query("drift_kl", psi_sql(LI_LF, kind="kl"))
def q_drift_kl(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.kl_divergence(r, c, LI_FEATS)


def chi2_sql(cells_cte, group):
    return f"""WITH {cells_cte},
u AS (SELECT * FROM cells WHERE nr + nc > 0),
t AS (SELECT {group}, sum(nr) AS R, sum(nc) AS C, count(*) AS k FROM u GROUP BY ALL),
j AS (SELECT u.*, R, C, k, CAST(R AS DOUBLE) * (nr + nc) / (R + C) AS er, CAST(C AS DOUBLE) * (nr + nc) / (R + C) AS ec
      FROM u JOIN t USING ({group})),
z AS (SELECT *, CASE WHEN k - 1 = 1 THEN greatest(abs(nr - er) - 0.5, 0.0) ELSE abs(nr - er) END AS dr_,
                CASE WHEN k - 1 = 1 THEN greatest(abs(nc - ec) - 0.5, 0.0) ELSE abs(nc - ec) END AS dc_ FROM j)
SELECT {group}, round(sum(CASE WHEN er > 0 THEN dr_ * dr_ / er ELSE 0.0 END + CASE WHEN ec > 0 THEN dc_ * dc_ / ec ELSE 0.0 END), 9) AS statistic,
       CAST(k - 1 AS BIGINT) AS dof FROM z GROUP BY {group}, k"""


@query("drift_chi2", chi2_sql(hist_sql(EV_LF) + ",\ncells AS (SELECT feature, bin, nr, nc FROM hj)", "feature"))
def q_drift_chi2(spark, sf):
    r, c = ev_halves(spark, sf)
    return dr.chi2_test(r, c, EV_FEATS).select("feature", "statistic", "dof")


@query("drift_chi2_pvalue")
def q_drift_chi2_pvalue(spark, sf):
    """χ² with p-values and drift flags (p from the incomplete gamma)."""
    r, c = ev_halves(spark, sf)
    return dr.chi2_test(r, c, EV_FEATS)


@query("drift_cvm", f"""WITH {EV_LF},
c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM lf GROUP BY ALL),
t AS (SELECT feature, sum(nr) AS N, sum(nc) AS M FROM c GROUP BY ALL),
cu AS (SELECT feature, value, nr, nc, sum(nr) OVER (PARTITION BY feature ORDER BY value) AS cr,
              sum(nc) OVER (PARTITION BY feature ORDER BY value) AS cc FROM c)
SELECT feature, CAST(N AS BIGINT) AS n_ref, CAST(M AS BIGINT) AS n_cur,
       round(N * M / pow(N + M, 2) * sum((nr + nc) * pow(cr / N - cc / M, 2)), 9) AS statistic
FROM cu JOIN t USING (feature) GROUP BY feature, N, M""")
def q_drift_cvm(spark, sf):
    r, c = ev_halves(spark, sf)
    return dr.cvm_test(r, c, EV_FEATS)


@query("drift_mmd")
def q_drift_mmd(spark, sf):
    e = table(spark, sf, "embeddings", ["embedding", "label"])
    return dr.rff_mmd(e.filter("label <= 4"), e.filter("label >= 5"), "embedding")


@query("drift_table")
def q_drift_table(spark, sf):
    """Per-column drift table: KS for numeric, χ² on categories for string
    columns; dataset drift when the drifted share is at least 0.5."""
    ev = table(spark, sf, "events", ["value", "user_id", "event_type", "ts"])
    r = ev.filter(F.col("ts") < ts_lit(EV_SPLIT))
    c = ev.filter(F.col("ts") >= ts_lit(EV_SPLIT))
    num = dr.ks_test(r, c, ["value", "user_id"]).select("feature", F.lit("ks").alias("test"), "statistic",
                                                         "p_value", "drifted")
    cat = dr.chi2_from_cells(dr.category_cells(r, c, ["event_type"]), ["feature"]) \
        .select("feature", F.lit("chi2").alias("test"), "statistic", "p_value", "drifted")
    per = num.unionByName(cat)
    share = per.agg(F.avg(F.col("drifted").cast("double")).alias("drift_share"))
    return per.withColumn("_k", F.lit(1)).join(share.withColumn("_k", F.lit(1)), "_k").drop("_k") \
        .withColumn("dataset_drift", F.col("drift_share") >= 0.5)


@query("drift_feature_rank", psi_sql(LI_LF).replace(
    "SELECT feature, round(", "SELECT *, row_number() OVER (ORDER BY psi DESC, feature) AS rank FROM (SELECT feature, round(", 1)
    + ")")
def q_drift_feature_rank(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.feature_rank(dr.psi(r, c, LI_FEATS), "psi")


@query("drift_severity", f"""WITH s AS ({psi_sql(LI_LF)})
SELECT feature, psi, drifted, CASE WHEN psi <= 0.1 THEN 'none' WHEN psi <= 0.1 * 1.5 THEN 'low'
  WHEN psi <= 0.1 * 2.0 THEN 'medium' WHEN psi <= 0.1 * 3.0 THEN 'high' ELSE 'critical' END AS severity FROM s""")
def q_drift_severity(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.psi(r, c, LI_FEATS).withColumn("severity", dr.severity(F.col("psi"), 0.1))


@query("drift_recommend", f"""WITH s AS ({psi_sql(LI_LF)}),
a AS (SELECT 'psi' AS method, round(avg(psi), 9) AS score, count(*) AS n_features, count(*) FILTER (WHERE drifted) AS n_drifted,
             coalesce(string_agg(CASE WHEN drifted THEN feature END, ',' ORDER BY feature), '') AS features_drifted,
             avg(psi) AS _s FROM s),
b AS (SELECT *, coalesce(_s > 0.1, false) AS is_drifted,
  CASE WHEN NOT coalesce(_s > 0.1, false) THEN 'none' WHEN _s <= 0.1 THEN 'none' WHEN _s <= 0.15 THEN 'low' WHEN _s <= 0.2 THEN 'medium'
       WHEN _s <= 0.30000000000000004 THEN 'high' ELSE 'critical' END AS severity FROM a),
f AS (SELECT *, list_filter(string_split(features_drifted, ','), lambda x: x <> '') AS fl FROM b)
SELECT method, score, is_drifted, n_features, n_drifted, features_drifted, severity,
  CASE WHEN is_drifted THEN concat_ws('; ', 'drift detected, re-evaluate model performance',
         CASE WHEN severity IN ('high', 'critical') THEN 'severe drift, retrain the model now' END,
         CASE WHEN len(fl) > 0 THEN 'drifted features: ' || array_to_string(fl[1:5], ', ') ||
              CASE WHEN len(fl) > 5 THEN printf(' and %d features in all', len(fl)) ELSE '' END END)
       ELSE '' END AS recommendation
FROM f""")
def q_drift_recommend(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.dataset_drift(dr.psi(r, c, LI_FEATS), "psi", "psi")


@query("drift_label", psi_sql(lf_sql("(SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS label, l_shipdate FROM lineitem)",
                                     ["label"], "l_shipdate", LI_SPLIT)))
def q_drift_label(spark, sf):
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_shipdate"]) \
        .select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"), "l_shipdate")
    r = li.filter(F.col("l_shipdate") < ts_lit(LI_SPLIT)).drop("l_shipdate")
    c = li.filter(F.col("l_shipdate") >= ts_lit(LI_SPLIT)).drop("l_shipdate")
    return dr.psi(r, c, ["label"])


_PAIRS = [(a, b) for i, a in enumerate(LI_FEATS) for b in LI_FEATS[i + 1:]]


@query("drift_corr", " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b,
      round(corr({a}, {b}) FILTER (WHERE l_shipdate < TIMESTAMP '{LI_SPLIT}'), 9) AS corr_ref,
      round(corr({a}, {b}) FILTER (WHERE l_shipdate >= TIMESTAMP '{LI_SPLIT}'), 9) AS corr_cur,
      round(abs(corr({a}, {b}) FILTER (WHERE l_shipdate < TIMESTAMP '{LI_SPLIT}') - corr({a}, {b}) FILTER (WHERE l_shipdate >= TIMESTAMP '{LI_SPLIT}')), 9) AS abs_diff
    FROM lineitem""" for a, b in _PAIRS))
def q_drift_corr(spark, sf):
    r, c = li_halves(spark, sf)
    return dr.correlation_drift(r, c, LI_FEATS)


@query("drift_embedding", """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) FILTER (WHERE label <= 4) AS m0, avg(x) FILTER (WHERE label >= 5) AS m1 FROM e GROUP BY i),
s AS (SELECT sum(m0 * m1) AS dot, sum(m0 * m0) AS na, sum(m1 * m1) AS nb, count(*) AS dims FROM m)
SELECT dims, round(dot / (sqrt(na) * sqrt(nb)), 6) AS cosine_similarity, round(1 - dot / (sqrt(na) * sqrt(nb)), 6) AS cosine_distance FROM s""")
def q_drift_embedding(spark, sf):
    e = table(spark, sf, "embeddings", ["embedding", "label"])
    return dr.embedding_drift(e.filter("label <= 4"), e.filter("label >= 5"), "embedding")


def doc_scores(spark, sf):
    """Model score stand-in: n_chars / (n_chars + 2000); label = quality."""
    d = table(spark, sf, "documents", ["doc_id", "lang", "n_chars"])
    return d.select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"))


DOC_SCORES_SQL = "ds AS (SELECT doc_id, lang, n_chars / (n_chars + 2000.0) AS score FROM documents)"


@query("drift_prediction", f"""WITH {DOC_SCORES_SQL},
k AS ({ks_sql("lf AS (SELECT 'score' AS feature, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS side, score AS value FROM ds)")}),
st AS (SELECT avg(score) FILTER (WHERE lang = 'en') AS rm, stddev_pop(score) FILTER (WHERE lang = 'en') AS rs,
              avg(score) FILTER (WHERE lang <> 'en') AS cm, stddev_pop(score) FILTER (WHERE lang <> 'en') AS cs FROM ds)
SELECT feature, statistic, p_value, drifted, round(rm, 9) AS ref_mean, round(rs, 9) AS ref_std,
       round(cm, 9) AS cur_mean, round(cs, 9) AS cur_std FROM k, st""")
def q_drift_prediction(spark, sf):
    s = doc_scores(spark, sf)
    return dr.prediction_drift(s.filter("lang = 'en'").select("score"), s.filter("lang <> 'en'").select("score"), "score")


@query("drift_concept_z", """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2),
last AS (SELECT event_type, max(d) AS ld FROM s GROUP BY 1),
h AS (SELECT s.event_type, avg(v) AS mh, stddev_samp(v) AS sh, count(*) AS nh FROM s JOIN last USING (event_type) WHERE d < ld GROUP BY 1),
c AS (SELECT s.event_type, v FROM s JOIN last USING (event_type) WHERE d = ld)
SELECT c.event_type, round(v, 9) AS current, round(mh, 9) AS mean_hist, round(sh, 9) AS std_hist, nh AS n_hist,
       round((v - mh) / sh, 6) AS z, coalesce(abs((v - mh) / sh) > 2.5, false) AS drifted FROM c JOIN h USING (event_type)""")
def q_drift_concept_z(spark, sf):
    ev = table(spark, sf, "events", ["event_type", "ts", "value"])
    s = ev.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    last = s.groupBy("event_type").agg(F.max("d").alias("ld"))
    j = s.join(last, "event_type")
    return dr.concept_z(j.filter(F.col("d") < F.col("ld")), j.filter(F.col("d") == F.col("ld")), "event_type", "v")


@query("drift_page_hinkley", """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2),
a AS (SELECT *, v - avg(v) OVER w - 0.005 AS dd FROM s WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, sum(dd) OVER w AS m FROM a WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, m - least(min(m) OVER w, 0.0) AS ph FROM b WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, d, round(v, 9) AS v, round(m, 6) AS m, round(ph, 6) AS ph, ph > 50.0 AS change FROM c""")
def q_drift_page_hinkley(spark, sf):
    ev = table(spark, sf, "events", ["event_type", "ts", "value"])
    s = ev.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return dr.page_hinkley(s, "event_type", "d", "v")


@query("drift_segment", psi_sql(lf_sql("events", ["value"], "ts", EV_SPLIT, keys="event_type"), keys="event_type"))
def q_drift_segment(spark, sf):
    ev = table(spark, sf, "events", ["event_type", "value", "ts"])
    r = ev.filter(F.col("ts") < ts_lit(EV_SPLIT)).drop("ts")
    c = ev.filter(F.col("ts") >= ts_lit(EV_SPLIT)).drop("ts")
    return dr.psi(r, c, ["value"], keys=["event_type"])


@query("drift_reference", ks_sql("""lf AS (SELECT 'value' AS feature,
  CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 0 ELSE 1 END AS side, value FROM events
  WHERE ts >= TIMESTAMP '2024-01-21' - INTERVAL 30 DAY AND value IS NOT NULL AND NOT isnan(value))"""))
def q_drift_reference(spark, sf):
    """Rolling reference: the 30 days before the cut-off (2024-01-21) kept
    as a snapshot, read back, vs everything after."""
    from vigil.sources.sinks import scratch_dir
    ev = table(spark, sf, "events", ["ts", "value"])
    cut = ts_lit("2024-01-21")
    path = scratch_dir(spark, "reference")
    dr.reference_snapshot(ev, "ts", cut, 30, path)
    ref = dr.latest_reference(spark, path).drop("ts")
    cur = ev.filter(F.col("ts") >= cut).drop("ts")
    return dr.ks_test(ref, cur, ["value"])


@query("drift_alert_rows", f"""WITH {DRIFT_RUNS_SQL}
SELECT model_name, ts, drift_score, severity,
       printf('drift detected for %s: score=%.4f, severity=%s', model_name, drift_score, severity) AS message
FROM drift_runs WHERE is_drifted""")
def q_drift_alert_rows(spark, sf):
    from vigil.operators.alerts import drift_alerts
    return drift_alerts(drift_runs(spark, sf))


@query("drift_summary", f"""WITH {DRIFT_RUNS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY model_name, is_drifted ORDER BY ts DESC) AS rn FROM drift_runs
      WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY)
SELECT model_name, count(*) AS total_checks, count(*) FILTER (WHERE is_drifted) AS drifted_checks,
  round(count(*) FILTER (WHERE is_drifted) / count(*), 9) AS drift_rate,
  count(*) FILTER (WHERE is_drifted AND severity = 'low') AS n_low,
  count(*) FILTER (WHERE is_drifted AND severity = 'medium') AS n_medium,
  count(*) FILTER (WHERE is_drifted AND severity = 'high') AS n_high,
  count(*) FILTER (WHERE is_drifted AND severity = 'critical') AS n_critical,
  coalesce(string_agg(CASE WHEN is_drifted AND rn <= 5 THEN strftime(ts, '%Y-%m-%d') END, ',' ORDER BY ts), '') AS recent_drifts,
  max(ts) AS last_check
FROM r GROUP BY model_name""")
def q_drift_summary(spark, sf):
    from vigil.operators.history import drift_summary
    return drift_summary(drift_runs(spark, sf), ts_lit("2024-02-01"), 30)
