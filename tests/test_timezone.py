"""Results do not depend on the session time zone: naive timestamps stay
naive, literals are built from text, watermarks read event times as UTC."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

NAMES = ["pit_join_ttl", "feature_freshness", "dq_freshness_days", "drift_ks", "st_profile", "st_sessions",
         "st_drift_psi", "retrain_triggers", "filter_period", "fe_window_counts", "hist_trend_time"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_in_other_time_zone(spark, name):
    con = duck(SF001)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF001)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["ok"], r.get("why")
