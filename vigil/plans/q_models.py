"""§2.10 / §2.11 model metric, lifecycle and lineage queries.

Model score stand-in: ``n_chars / (n_chars + 2000)`` per document, label =
``labels.quality``; prediction = score ≥ 0.5."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import models as mo
from vigil.operators import lineage as ln
from vigil.plans.fixtures import DQ_CHECKS_SQL, DQ_RUNS_SQL, LIFECYCLE_SQL, dq_checks, lifecycle_events
from vigil.plans.registry import query
from vigil.sources.readers import table


def scored(spark, sf, how="inner"):
    d = table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    lab = table(spark, sf, "labels", ["doc_id", "quality"])
    j = d.join(lab, "doc_id", how)
    s = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return j.select("doc_id", "lang", "source", s.alias("score"), F.col("quality").alias("label"),
                    F.when(s >= 0.5, 1).otherwise(0).alias("pred"))


SCORED = """sc AS (SELECT d.doc_id, lang, source, n_chars / (n_chars + 2000.0) AS score, quality AS label,
  CASE WHEN n_chars / (n_chars + 2000.0) >= 0.5 THEN 1 ELSE 0 END AS pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

#: Documents without a label too.
SCORED_ALL = SCORED.replace("JOIN labels", "LEFT JOIN labels")


def _cls_sql(src="sc", keys=""):
    k = f"{keys}, " if keys else ""
    gb = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn,
  count(*) FILTER (WHERE label IS NULL OR pred IS NULL) AS n_dropped FROM {src} {gb}"""


def _cls_cols(keys=""):
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 9) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(2 * coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) * coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0)
    / nullif(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) + coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 0), 0.0), 9) AS f1"""


@query("cls_metrics", f"WITH {SCORED_ALL}, c AS ({_cls_sql()})\n{_cls_cols()}, n_dropped FROM c")
def q_cls_metrics(spark, sf):
    return mo.cls_metrics(scored(spark, sf, "left"), "label", "pred")


@query("drift_performance", f"""WITH {SCORED}, s AS (SELECT *, CASE WHEN lang = 'en' THEN 'reference' ELSE 'current' END AS side FROM sc),
c AS ({_cls_sql('s', 'side')}), m AS ({_cls_cols('side')} FROM c),
r AS (SELECT * FROM m WHERE side = 'reference'), k AS (SELECT * FROM m WHERE side = 'current')
SELECT r.accuracy AS ref_accuracy, k.accuracy AS cur_accuracy, round(r.accuracy - k.accuracy, 9) AS accuracy_drop,
  round(r.precision - k.precision, 9) AS precision_drop, round(r.recall - k.recall, 9) AS recall_drop, round(r.f1 - k.f1, 9) AS f1_drop,
  (r.accuracy - k.accuracy > 0.1 OR r.precision - k.precision > 0.1 OR r.recall - k.recall > 0.1 OR r.f1 - k.f1 > 0.1) AS degraded
FROM r, k""")
def q_drift_performance(spark, sf):
    s = scored(spark, sf).withColumn("side", F.when(F.col("lang") == "en", "reference").otherwise("current"))
    m = mo.cls_metrics(s, "label", "pred", ["side"])
    r = m.filter("side = 'reference'").select(*[F.col(c).alias(f"r_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    k = m.filter("side = 'current'").select(*[F.col(c).alias(f"k_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    j = r.withColumn("_j", F.lit(1)).join(k.withColumn("_j", F.lit(1)), "_j")
    drops = {c: F.round(F.col(f"r_{c}") - F.col(f"k_{c}"), 9) for c in ("accuracy", "precision", "recall", "f1")}
    raw = [F.col(f"r_{c}") - F.col(f"k_{c}") > 0.1 for c in ("accuracy", "precision", "recall", "f1")]
    return j.select(F.col("r_accuracy").alias("ref_accuracy"), F.col("k_accuracy").alias("cur_accuracy"),
                    *[v.alias(f"{c}_drop") for c, v in drops.items()],
                    (raw[0] | raw[1] | raw[2] | raw[3]).alias("degraded"))


def _auc_sql(score="score", src="sc", base=SCORED):
    return f"""WITH {base}, g AS (SELECT CAST({score} AS DOUBLE) AS s, count(*) FILTER (WHERE label = 1) AS pos,
    count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  (SELECT count(*) FROM {src} WHERE label IS NULL) AS n_dropped,
  round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM c"""


@query("auc", _auc_sql(base=SCORED_ALL))
def q_auc(spark, sf):
    return mo.auc(scored(spark, sf, "left"), "label", "score")


@query("reg_metrics", """WITH j AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT count(*) AS n, round(avg(abs(y - p)), 9) AS mae, round(avg((y - p) * (y - p)), 6) AS mse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2 FROM j""")
def q_reg_metrics(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_extendedprice"])
    p = table(spark, sf, "part", ["p_partkey", "p_retailprice"])
    j = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_extendedprice").alias("y"),
                                                       (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    return mo.reg_metrics(j, "y", "p")


@query("confusion_matrix", f"""WITH {SCORED}
SELECT label, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM sc GROUP BY label""")
def q_confusion_matrix(spark, sf):
    return mo.confusion_matrix(scored(spark, sf), "label", "pred", [0, 1])


@query("fairness", f"""WITH {SCORED}, g AS (SELECT lang, avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0.0 END) AS pr,
  CAST(count(*) FILTER (WHERE pred = 1 AND label = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0) AS tpr FROM sc GROUP BY lang)
SELECT count(*) AS n_groups, round(min(pr) / nullif(max(pr), 0), 9) AS disparate_impact, round(max(tpr) - min(tpr), 9) AS equal_opportunity_diff,
  coalesce(min(pr) / nullif(max(pr), 0) >= 0.8, false) AS passed FROM g""")
def q_fairness(spark, sf):
    return mo.fairness(scored(spark, sf), "lang", "label", "pred")


@query("error_slices", f"""WITH {SCORED}, e AS (SELECT *, CASE WHEN pred <> label THEN 1.0 ELSE 0.0 END AS err FROM sc),
o AS (SELECT avg(err) AS ov FROM e),
s AS (SELECT 'lang' AS feature, lang AS value, count(*) AS n, avg(err) AS er FROM e GROUP BY 2
      UNION ALL SELECT 'source', source, count(*), avg(err) FROM e GROUP BY 2
      UNION ALL SELECT 'lang & source', lang || ' & ' || source, count(*), avg(err) FROM e GROUP BY 2)
SELECT feature, value, n, round(er, 9) AS error_rate, round(er / nullif(ov, 0), 9) AS lift FROM s, o""")
def q_error_slices(spark, sf):
    s = scored(spark, sf).withColumn("err", (F.col("pred") != F.col("label")).cast("double"))
    return mo.error_slices(s, ["lang", "source"], "err", pairs=True)


@query("confidence_entropy", """WITH x AS (SELECT CAST(ts AS DATE) AS period, CAST(least(floor(value / 500.0 * 10), 9) AS INTEGER) AS bin,
  CASE WHEN value > 250 THEN 1 ELSE 0 END AS p FROM events),
h AS (SELECT period, bin, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT period, count(*) AS tt, avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) AS pos FROM x GROUP BY 1)
SELECT period, tt AS n, round(-sum(CAST(n AS DOUBLE) / tt * log2(CAST(n AS DOUBLE) / tt)), 9) AS entropy, round(pos, 9) AS positive_share
FROM h JOIN t USING (period) GROUP BY period, tt, pos""")
def q_confidence_entropy(spark, sf):
    ev = table(spark, sf, "events", ["ts", "value"]).select(
        "ts", (F.col("value") / 500.0).alias("conf"), F.when(F.col("value") > 250, 1).otherwise(0).alias("pred"))
    return mo.confidence_entropy(ev, "conf", F.to_date("ts"), "pred")


def _metric_long(m):
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                        for c in ("accuracy", "precision", "recall", "f1")])).alias("s")).select("s.*")


@query("metric_gate", f"""WITH {SCORED}, c1 AS ({_cls_sql("(SELECT * FROM sc WHERE lang = 'en')")}),
c2 AS ({_cls_sql("(SELECT * FROM sc WHERE lang <> 'en')")}), m1 AS ({_cls_cols()} FROM c1), m2 AS ({_cls_cols()} FROM c2),
l1 AS (UNPIVOT m1 ON accuracy, precision, recall, f1 INTO NAME metric VALUE cand),
l2 AS (UNPIVOT m2 ON accuracy, precision, recall, f1 INTO NAME metric VALUE base)
SELECT l1.metric, cand, base, coalesce(cand >= 0.9 * base, true) AND coalesce(cand >= CASE l1.metric WHEN 'accuracy' THEN 0.8 WHEN 'f1' THEN 0.7 END, true) AS ok
FROM l1 LEFT JOIN l2 ON l1.metric = l2.metric""")
def q_metric_gate(spark, sf):
    s = scored(spark, sf)
    cand = _metric_long(mo.cls_metrics(s.filter("lang = 'en'"), "label", "pred"))
    base = _metric_long(mo.cls_metrics(s.filter("lang <> 'en'"), "label", "pred"))
    return mo.metric_gate(cand, base)


@query("champion_challenger", f"""WITH a AS ({_auc_sql()}), b AS ({_auc_sql("1.0 - abs(n_chars - 2000.0) / (n_chars + 2000.0)", "(SELECT sc.*, d.n_chars FROM sc JOIN documents d USING (doc_id))")})
SELECT a.auc AS champion_auc, b.auc AS challenger_auc, round(b.auc - a.auc, 9) AS delta, b.auc - a.auc > 0.01 AS promote FROM a, b""")
def q_champion_challenger(spark, sf):
    s = scored(spark, sf)
    d = table(spark, sf, "documents", ["doc_id", "n_chars"])
    s2 = s.join(d, "doc_id").withColumn("score_b", 1.0 - F.abs(F.col("n_chars") - 2000.0) / (F.col("n_chars") + 2000.0))
    a = mo.auc(s, "label", "score").select(F.col("auc").alias("champion_auc"))
    b = mo.auc(s2, "label", "score_b").select(F.col("auc").alias("challenger_auc"))
    j = a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j")
    return j.select("champion_auc", "challenger_auc", F.round(F.col("challenger_auc") - F.col("champion_auc"), 9).alias("delta"),
                    (F.col("challenger_auc") - F.col("champion_auc") > 0.01).alias("promote"))


@query("run_durations", """WITH d AS (SELECT event_type, event_type = 'error' AS failed,
  (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6 AS dur FROM events)
SELECT event_type, count(*) AS n_steps, round(avg(dur), 9) AS mean_duration_s, count(*) FILTER (WHERE failed) AS n_failed,
  round(quantile_cont(dur, 0.95), 9) AS p95_duration_s FROM d GROUP BY event_type""")
def q_run_durations(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "event_type", "ts"])
    return mo.run_durations(ev, "user_id", "event_type", "ts", F.col("event_type") == "error")


# ------------------------------------------------------------- lifecycle
_L = f"WITH {LIFECYCLE_SQL}\n"
_CUR = """cur AS (SELECT model, version, arg_max(to_state, (ts, event_id)) AS current_state, max(ts) AS last_ts, count(*) AS n_events
  FROM lifecycle_events GROUP BY model, version)"""


@query("lifecycle_state", _L + f", {_CUR}\nSELECT * FROM cur")
def q_lifecycle_state(spark, sf):
    return mo.current_state(lifecycle_events(spark, sf), ["model", "version"])


@query("lifecycle_recent", _L + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY ts DESC, event_id DESC) AS k FROM lifecycle_events)
SELECT model, version, count(*) AS n_recent, min(ts) AS since, string_agg(to_state, ',' ORDER BY k) AS recent_states
FROM r WHERE k <= 10 GROUP BY model, version""")
def q_lifecycle_recent(spark, sf):
    return mo.recent_events(lifecycle_events(spark, sf), ["model", "version"])


@query("lifecycle_report", _L + f""", {_CUR},
r AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY ts DESC, event_id DESC) AS k FROM lifecycle_events),
v AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY ts DESC, event_id DESC) AS k FROM lifecycle_events WHERE to_state = 'validated'),
rs AS (SELECT model, version, string_agg(to_state, ',' ORDER BY k) AS recent_states FROM r WHERE k <= 10 GROUP BY 1, 2),
vs AS (SELECT model, version, count(*) AS n, string_agg((CASE WHEN score < 0.3 THEN 'failed' ELSE 'passed' END) || ':' || (event_id % 4) || '/' || (event_id % 3) || '/' || (event_id % 2),
  ',' ORDER BY k) AS validations FROM v WHERE k <= 5 GROUP BY 1, 2),
ds AS (SELECT model, version, count(*) AS n, string_agg(event_id || ':' || CASE WHEN event_id % 2 = 0 THEN 'production' ELSE 'staging' END, ',' ORDER BY event_id) AS deployments
  FROM lifecycle_events WHERE to_state = 'deployed' GROUP BY 1, 2)
SELECT cur.model, cur.version, current_state, recent_states, coalesce(vs.n, 0) AS n_validations, coalesce(validations, '') AS validations,
  coalesce(ds.n, 0) AS n_deployments, coalesce(deployments, '') AS deployments
FROM cur LEFT JOIN rs USING (model, version) LEFT JOIN vs USING (model, version) LEFT JOIN ds USING (model, version)""")
def q_lifecycle_report(spark, sf):
    """Validations are the 'validated' events, deployments the 'deployed' ones."""
    ev = lifecycle_events(spark, sf)
    number = lambda k: (F.col("event_id") % k).cast("long")
    runs = ev.filter("to_state = 'validated'").withColumn("status", F.when(F.col("score") < 0.3, "failed").otherwise("passed")) \
        .withColumn("passed", number(4)).withColumn("failed", number(3)).withColumn("warnings", number(2))
    held = ev.filter("to_state = 'deployed'").withColumnRenamed("event_id", "deployment_id") \
        .withColumn("stage", F.when(F.col("deployment_id") % 2 == 0, "production").otherwise("staging"))
    return mo.lifecycle_report(ev, runs, held, ["model", "version"])


@query("latest_production", _L + f""", {_CUR}
SELECT model, arg_max(version, (last_ts, version)) AS production_version, max(last_ts) AS since, count(*) AS n_active
FROM cur WHERE current_state = 'deployed' GROUP BY model""")
def q_latest_production(spark, sf):
    return mo.latest_production(lifecycle_events(spark, sf))


@query("prod_conflicts", _L + f""", {_CUR}
SELECT model, count(*) AS n_active FROM cur WHERE current_state = 'deployed' GROUP BY model HAVING count(*) > 1""")
def q_prod_conflicts(spark, sf):
    return mo.prod_conflicts(lifecycle_events(spark, sf))


@query("promote_apply", _L + """SELECT model, version, ts AS valid_from,
  lead(ts) OVER (PARTITION BY model ORDER BY ts, event_id) AS valid_to,
  lead(version) OVER (PARTITION BY model ORDER BY ts, event_id) AS replaced_by,
  lead(ts) OVER (PARTITION BY model ORDER BY ts, event_id) IS NULL AS is_current
FROM lifecycle_events WHERE to_state = 'deployed'""")
def q_promote_apply(spark, sf):
    return mo.promote_apply(lifecycle_events(spark, sf))


# Allowed lifecycle transitions (deploy only from validated or registered)
ALLOWED = [("registered", "validated"), ("validated", "validated"), ("validated", "deployed"),
           ("registered", "deployed"), ("deployed", "archived"),
           ("validated", "archived"), ("archived", "archived"), ("deployed", "validated")]


@query("lifecycle_illegal", _L + f""", a(from_state, to_state) AS (VALUES {", ".join(f"('{x}', '{y}')" for x, y in ALLOWED)}),
t AS (SELECT *, lag(to_state) OVER (PARTITION BY model, version ORDER BY ts, event_id) AS from_state FROM lifecycle_events)
SELECT model, version, ts, event_id, t.from_state, t.to_state FROM t
WHERE t.from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.from_state = t.from_state AND a.to_state = t.to_state)""")
def q_lifecycle_illegal(spark, sf):
    allowed = spark.createDataFrame(ALLOWED, "from_state string, to_state string")
    return mo.lifecycle_illegal(lifecycle_events(spark, sf), allowed, ["model", "version"])


@query("deployment_history", _L + f""", {_CUR}
SELECT d.model, d.version, n_deployments, first_deployed, last_deployed, current_state AS latest_status FROM (
  SELECT model, version, count(*) AS n_deployments, min(ts) AS first_deployed, max(ts) AS last_deployed
  FROM lifecycle_events WHERE to_state = 'deployed' GROUP BY model, version) d JOIN cur USING (model, version)""")
def q_deployment_history(spark, sf):
    return mo.deployment_history(lifecycle_events(spark, sf))


@query("version_top5", _L + """SELECT * FROM (SELECT model, version, max(ts) AS last_ts,
  row_number() OVER (PARTITION BY model ORDER BY max(ts) DESC, version DESC) AS rank FROM lifecycle_events GROUP BY model, version)
WHERE rank <= 5""")
def q_version_top5(spark, sf):
    return mo.version_top(lifecycle_events(spark, sf), 5)


@query("compare_versions", _L + """SELECT model, version, CAST(count(*) AS DOUBLE) AS n_events, round(avg(score), 9) AS avg_score,
  CAST(count(*) FILTER (WHERE to_state = 'deployed') AS DOUBLE) AS n_deployed FROM lifecycle_events GROUP BY model, version""")
def q_compare_versions(spark, sf):
    ev = lifecycle_events(spark, sf)
    m = ev.groupBy("model", "version").agg(F.count(F.lit(1)).cast("double").alias("n_events"),
                                           F.round(F.avg("score"), 9).alias("avg_score"),
                                           F.count_if(F.col("to_state") == "deployed").cast("double").alias("n_deployed"))
    long = m.unpivot(["model", "version"], ["n_events", "avg_score", "n_deployed"], "metric", "value")
    return mo.compare_versions(long, "model", "version", "metric", "value", ["n_events", "avg_score", "n_deployed"])


@query("tags_to_maps", """SELECT o_orderkey, 'priority=' || o_orderpriority AS metadata, 'status=' || o_orderstatus AS artifact,
  'owner=team_' || CAST(o_custkey % 7 AS VARCHAR) AS other FROM orders""")
def q_tags_to_maps(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"])
    tagged = o.select("o_orderkey", F.create_map(
        F.lit("meta.priority"), F.col("o_orderpriority"), F.lit("artifact.status"), F.col("o_orderstatus"),
        F.lit("owner"), F.concat(F.lit("team_"), (F.col("o_custkey") % 7).cast("string"))).alias("tags"))
    m = mo.tags_to_maps(tagged, "tags", {"metadata": "meta.", "artifact": "artifact."})
    return m.select("o_orderkey", mo.map_text(F.col("metadata")).alias("metadata"),
                    mo.map_text(F.col("artifact")).alias("artifact"), mo.map_text(F.col("other")).alias("other"))


@query("validation_rollup", f"""WITH {DQ_CHECKS_SQL},
c AS (SELECT dataset, CAST(ts AS DATE) AS day, check_name AS r, status FROM dq_checks)
SELECT dataset, day, coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE status = 'passed'), '') AS passed,
  coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE status IN ('failed', 'error')), '') AS failed,
  coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE status = 'warning'), '') AS warnings,
  CASE WHEN count(*) FILTER (WHERE status IN ('failed', 'error')) > 0 THEN 'failed'
       WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS status FROM c GROUP BY dataset, day""")
def q_validation_rollup(spark, sf):
    c = dq_checks(spark, sf).withColumn("rule_id", F.col("check_name")).withColumn("day", F.to_date("ts"))
    return mo.validation_rollup(c, ["dataset", "day"])


@query("score_postproc", """SELECT l_orderkey, l_linenumber,
  round(1 / (1 + exp(-((l_discount - 0.05) * 50))), 9) AS prob, CASE WHEN 1 / (1 + exp(-((l_discount - 0.05) * 50))) >= 0.5 THEN 1 ELSE 0 END AS label,
  CAST(list_position([l_quantity / 10, l_tax * 100, l_discount * 100], list_max([l_quantity / 10, l_tax * 100, l_discount * 100])) - 1 AS INTEGER) AS argmax,
  round(exp(list_max([l_quantity / 10, l_tax * 100, l_discount * 100])) / (exp(l_quantity / 10) + exp(l_tax * 100) + exp(l_discount * 100)), 9) AS max_prob
FROM lineitem""")
def q_score_postproc(spark, sf):
    from vigil.operators.ml import argmax_softmax, sigmoid_label
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"])
    logits = F.array(F.col("l_quantity") / 10, F.col("l_tax") * 100, F.col("l_discount") * 100)
    prob, label = sigmoid_label((F.col("l_discount") - 0.05) * 50)
    am, mp = argmax_softmax(logits)
    return li.select("l_orderkey", "l_linenumber", F.round(prob, 9).alias("prob"), label.alias("label"),
                     am.alias("argmax"), F.round(mp, 9).alias("max_prob"))


# --------------------------------------------------------------- lineage
def lineage_graph(spark, sf):
    """Key edges region → nation → customer → orders → lineitem."""
    n = table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    return ln.build_edges(ln.key_edges(n, "nation", ["n_nationkey"], "region", "n_regionkey", "CONTAINS"),
                          ln.key_edges(c, "customer", ["c_custkey"], "nation", "c_nationkey", "CONTAINS"),
                          ln.key_edges(o, "orders", ["o_orderkey"], "customer", "o_custkey", "PLACED"),
                          ln.key_edges(li, "lineitem", ["l_orderkey", "l_linenumber"], "orders", "l_orderkey", "HAS_LINE"))


_EDGES_SQL = """edges AS (SELECT DISTINCT * FROM (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'PLACED' FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'lineitem:' || l_orderkey || ':' || l_linenumber, 'HAS_LINE' FROM lineitem))"""


def record_edges(spark, sf):
    """Edges from run and registration records: dataset → quality run
    (VALIDATED_BY) and model → model version (HAS_VERSION)."""
    from vigil.plans.fixtures import dq_runs
    runs = dq_runs(spark, sf).select(F.concat(F.lit("dataset:"), "dataset").alias("src"),
                                     F.concat(F.lit("run:"), "run_id").alias("dst"), F.lit("VALIDATED_BY").alias("type"))
    ver = lifecycle_events(spark, sf).select(
        F.concat(F.lit("model:"), "model").alias("src"),
        F.concat(F.lit("version:"), "model", F.lit("/"), F.col("version").cast("string")).alias("dst"),
        F.lit("HAS_VERSION").alias("type"))
    return runs.unionByName(ver)


@query("lineage_edges", f"""WITH {DQ_RUNS_SQL}, {LIFECYCLE_SQL}, {_EDGES_SQL}
SELECT * FROM edges
UNION SELECT 'dataset:' || dataset, 'run:' || run_id, 'VALIDATED_BY' FROM dq_runs
UNION SELECT 'model:' || model, 'version:' || model || '/' || CAST(version AS VARCHAR), 'HAS_VERSION' FROM lifecycle_events""")
def q_lineage_edges(spark, sf):
    return ln.build_edges(lineage_graph(spark, sf), record_edges(spark, sf))


@query("lineage_impact", f"""WITH RECURSIVE {_EDGES_SQL},
r(node, depth) AS (SELECT 'region:1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def q_lineage_impact(spark, sf):
    seeds = spark.range(1).select(F.lit("region:1").alias("node"))
    return ln.reachable(lineage_graph(spark, sf), seeds, "down").select("node", F.col("depth").cast("int"))


@query("ab_assign")
def q_ab_assign(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id", "value", "event_type"])
    return mo.ab_assign(ev, "user_id", 0.2)


@query("ab_compare")
def q_ab_compare(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id", "value", "event_type"])
    a = mo.ab_assign(ev, "user_id", 0.5).withColumn("ok", F.col("event_type") != "error")
    return mo.ab_compare(a, "variant", "ok", "value")
