"""
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``
and prints one JSON line.  Each query is forced completely with the
``noop`` sink (every column computed, nothing collected); the reported
time is the median of ``$BENCH_RUNS`` (default 3) runs after
``$BENCH_WARMUP`` (default 2) warm-up runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def headline():
    from pyspark.sql import functions as F

    from vigil.operators import drift as dr
    from vigil.operators import profile as pr
    from vigil.operators import quality as q
    from vigil.operators.history import quality_report
    from vigil.plans.fixtures import dq_checks
    from vigil.plans.q_drift import LI_FEATS, li_halves
    from vigil.plans.q_featurestore import pit_ttl
    from vigil.plans.q_stream import q_st_profile
    from vigil.functions.core import ts_lit
    from vigil.sources.readers import table

    return {
        "profile_numeric": lambda s, d: pr.profile_numeric(table(s, d, "lineitem"),
                                                           ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
        "dq_score": lambda s, d: q.dq_score(q.quality_metrics(table(s, d, "orders"), "orders", ts_lit("2001-09-01"))),
        "pit_join_ttl": lambda s, d: pit_ttl(s, d),
        "drift_ks": lambda s, d: dr.ks_test(*li_halves(s, d), LI_FEATS),
        "drift_psi": lambda s, d: dr.psi(*li_halves(s, d), LI_FEATS),
        "quality_report": lambda s, d: quality_report(dq_checks(s, d)),
        "st_profile": q_st_profile,
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warmup = int(os.environ.get("BENCH_WARMUP", "2"))
    from vigil.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app="vigil-bench",
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    results, errors = {}, {}
    for name, fn in headline().items():
        times = []
        try:
            for i in range(runs + warmup):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i >= warmup:  # warm-up runs compile code paths and cache file listings
                    times.append(dt)
            results[name] = round(statistics.median(times), 3)
        except Exception as ex:  # noqa: BLE001 - report and go on with the others
            results[name] = None
            errors[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_median_sec", "value": round(sum(v for v in results.values() if v), 3),
           "unit": "sec", "queries": results, "sf": sf, "cpus": cpus, "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
