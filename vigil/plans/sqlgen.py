"""DuckDB SQL text for the oracle side of the quality queries.  Written
independently of the Spark operators: plain aggregates over the views."""

from __future__ import annotations

from vigil.operators.quality import ALL_FAMILIES, DEFAULT_THRESHOLDS, MONITOR_WEIGHTS, STATUS_BANDS, TYPE_KEYWORDS


def missing_sql(c: str, kind: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if kind == "float" else f"({c} IS NULL)"


def metrics_sql(prefix: str, source: str, schema, dataset: str, as_of: str | None = None,
                families=ALL_FAMILIES) -> tuple[str, str]:
    """Returns (CTE text, name of the CTE with the metric rows)."""
    fam = set(families)
    cols = [c for c, _ in schema]
    num = [(c, k) for c, k in schema if k in ("int", "float")]
    fresh = [c for c, k in schema if k == "time" and ("date" in c.lower() or "time" in c.lower())] if as_of else []
    w = ["count(*) AS _rows"]
    for c, k in schema:
        w.append(f"count(*) FILTER (WHERE {missing_sql(c, k)}) AS {c}__miss")
        if "profile_uniqueness" in fam:
            w.append(f"count(DISTINCT CASE WHEN NOT {missing_sql(c, k)} THEN {c} END) AS {c}__dist")
    for c, k in num:
        if "zero" in fam:
            w.append(f"count(*) FILTER (WHERE NOT {missing_sql(c, k)} AND {c} = 0) AS {c}__zero")
        if "profile_validity" in fam:
            w.append(f"count(*) FILTER (WHERE NOT {missing_sql(c, k)} AND abs(CAST({c} AS DOUBLE)) < 'inf'::DOUBLE) AS {c}__fin")
    if "freshness" in fam:
        for c in fresh:
            w.append(f"max({c}) AS {c}__max")
    ctes = [f"{prefix}w AS (SELECT {', '.join(w)} FROM {source})"]
    froms = [f"{prefix}w"]
    if "duplicate" in fam:
        ctes.append(f"{prefix}d AS (SELECT coalesce(sum(n - 1), 0) AS _dups FROM "
                    f"(SELECT count(*) AS n FROM {source} GROUP BY {', '.join(cols)}))")
        froms.append(f"{prefix}d")
    if "outlier" in fam and num:
        qs = ", ".join(
            f"quantile_cont({c}, 0.25) FILTER (WHERE NOT {missing_sql(c, k)}) AS {c}__q1, "
            f"quantile_cont({c}, 0.75) FILTER (WHERE NOT {missing_sql(c, k)}) AS {c}__q3" for c, k in num)
        ctes.append(f"{prefix}q AS (SELECT {qs} FROM {source})")
        outs = ", ".join(
            f"count(*) FILTER (WHERE NOT {missing_sql(c, k)} AND ({c} < {c}__q1 - 1.5 * ({c}__q3 - {c}__q1) "
            f"OR {c} > {c}__q3 + 1.5 * ({c}__q3 - {c}__q1))) AS {c}__out" for c, k in num)
        ctes.append(f"{prefix}o AS (SELECT {outs} FROM {source}, {prefix}q)")
        froms.append(f"{prefix}o")
    fr = ", ".join(froms)
    rows = []

    def row(name, col, mtype, value, thr, direction):
        col_s = f"'{col}'" if col else "CAST(NULL AS VARCHAR)"
        mt = f"'{mtype}'" if mtype else "CAST(NULL AS VARCHAR)"
        th = str(thr) if thr is not None else "CAST(NULL AS DOUBLE)"
        dr = f"'{direction}'" if direction else "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT '{dataset}' AS dataset, '{name}' AS name, {col_s} AS \"column\", {mt} AS metric_type, "
                    f"CAST({value} AS DOUBLE) AS value, CAST({th} AS DOUBLE) AS threshold, {dr} AS direction FROM {fr}")

    if "overall" in fam:
        tot = " + ".join(f"{c}__miss" for c in cols)
        row("overall_completeness", None, "completeness", f"1 - CAST({tot} AS DOUBLE) / (_rows * {len(cols)})", 0.95, "ge")
    if "duplicate" in fam:
        row("duplicate_rate", None, "uniqueness", "CAST(_dups AS DOUBLE) / _rows", 0.05, "le")
    if "missing" in fam:
        for c in cols:
            row(f"missing_rate_{c}", c, "completeness", f"CAST({c}__miss AS DOUBLE) / _rows", 0.10, "le")
    for c, _ in num:
        if "zero" in fam:
            row(f"zero_rate_{c}", c, "validity", f"CAST({c}__zero AS DOUBLE) / nullif(_rows - {c}__miss, 0)", 0.5, "le")
        if "outlier" in fam:
            row(f"outlier_rate_{c}", c, "validity", f"CAST({c}__out AS DOUBLE) / nullif(_rows - {c}__miss, 0)", 0.05, "le")
    if "freshness" in fam:
        for c in fresh:
            row(f"data_freshness_{c}", c, "timeliness",
                f"floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us({c}__max)) / 86400e6)", 7.0, "le")
    for c in cols:
        if "profile_completeness" in fam:
            row(f"profile_completeness_{c}", c, None, f"1 - CAST({c}__miss AS DOUBLE) / _rows", None, None)
        if "profile_uniqueness" in fam:
            row(f"profile_uniqueness_{c}", c, None, f"CAST({c}__dist AS DOUBLE) / _rows", None, None)
    if "profile_validity" in fam:
        for c, _ in num:
            row(f"profile_validity_{c}", c, None, f"CAST({c}__fin AS DOUBLE) / _rows", None, None)
    ctes.append(f"{prefix}raw AS ({' UNION ALL '.join(rows)})")
    thr_vals = ", ".join(f"('{n}', '{t}', {w_}, {e}, '{d}')" for n, t, w_, e, d in DEFAULT_THRESHOLDS)
    ctes.append(f"{prefix}thr(t_name, t_type, warning, error, t_direction) AS (VALUES {thr_vals})")
    ctes.append(f"""{prefix}m0 AS (SELECT r.dataset, r.name, r."column",
        coalesce(r.metric_type, t.t_type, {type_case_sql('r.name')}) AS metric_type, r.value,
        coalesce(r.threshold, t.warning) AS threshold, coalesce(r.direction, t.t_direction) AS direction
        FROM {prefix}raw r LEFT JOIN {prefix}thr t ON r.name = t.t_name WHERE r.value IS NOT NULL)""")
    ctes.append(f"""{prefix}metrics AS (SELECT *, {status_sql()} AS status FROM {prefix}m0)""")
    return ",\n".join(ctes), f"{prefix}metrics"


def type_case_sql(name: str) -> str:
    parts = []
    for typ, words in TYPE_KEYWORDS:
        cond = " OR ".join(f"contains(lower({name}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{typ}'")
    return "CASE " + " ".join(parts) + " ELSE 'completeness' END"


def status_sql(v="value", t="threshold", d="direction") -> str:
    return (f"CASE WHEN {t} IS NULL THEN 'measured' WHEN {d} = 'ge' AND {v} >= {t} THEN 'passed' "
            f"WHEN {d} = 'le' AND {v} <= {t} THEN 'passed' ELSE 'failed' END")


def weight_sql(t="metric_type") -> str:
    return "CASE " + " ".join(f"WHEN {t} = '{k}' THEN {w}" for k, w in MONITOR_WEIGHTS.items()) + " ELSE 0.05 END"


def metric_score_sql(v="value", t="threshold", d="direction") -> str:
    return (f"CASE WHEN {t} IS NULL THEN 50.0 WHEN {d} = 'ge' THEN "
            f"(CASE WHEN {v} >= {t} THEN 100.0 ELSE {v} / {t} * 100 END) "
            f"ELSE (CASE WHEN {v} <= {t} THEN 100.0 ELSE greatest(0.0, 100 - ({v} - {t}) / {t} * 100) END) END")


def band_sql(score: str, crit: str = "0") -> str:
    s = f"CASE WHEN {crit} >= 3 THEN 'failed' "
    s += " ".join(f"WHEN {score} >= {lo} THEN '{st}'" for lo, st in STATUS_BANDS)
    return s + " ELSE 'failed' END"


def score_sql(metrics_cte: str) -> str:
    crit = ("count(*) FILTER (WHERE status = 'failed' AND ((direction = 'ge' AND value < threshold * 0.5) "
            "OR (direction = 'le' AND value > threshold * 2.0)))")
    return f"""SELECT dataset, round(sum(({metric_score_sql()}) * ({weight_sql()})) / sum({weight_sql()}), 9) AS _score,
        {crit} AS critical_failures FROM {metrics_cte} GROUP BY dataset"""
