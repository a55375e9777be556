"""Plan shape checks: no cartesian products or Python UDFs in the core,
filters and column pruning reach the scan, profiles are one pass."""

import pytest

from kiln.registry import queries
from tests.conftest import SF001

CORE = ["risk_score_report", "process_prevalence_report", "email_domain", "top_domains", "network_inventory_report",
        "ip_range_join", "bandwidth_24h", "first_contact", "tfidf", "string_agg_filtered", "join_left_chain",
        "dedupe_by_group_keys", "filter_eq_cmp", "json_to_columns", "html_to_text"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", CORE)
def test_no_cartesian_or_python(spark, key):
    p = plan(queries()[key](spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{key}: {bad}"


def formatted(spark, df, name):
    df.createOrReplaceTempView(name)
    return spark.sql(f"EXPLAIN FORMATTED SELECT * FROM {name}").first()[0]


def test_filter_pushdown(spark):
    p = formatted(spark, queries()["filter_eq_cmp"](spark, SF001), "v_filter")
    assert "EqualTo(c_mktsegment,BUILDING)" in p and "GreaterThanOrEqual(c_acctbal,0.0)" in p


def test_pruned_read_schema(spark):
    from kiln.sources.tables import Tables
    df = Tables(spark, SF001).lineitem.select("l_orderkey", "l_quantity").where("l_quantity > 10")
    p = formatted(spark, df, "v_pruned")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "GreaterThan(l_quantity,10.0)" in p


def test_one_pass_profile(spark):
    from kiln.operators.profile import missing_counts
    from kiln.sources.tables import Tables
    p = formatted(spark, missing_counts(Tables(spark, SF001).lineitem), "v_missing")
    import re
    assert len(re.findall(r"\(\d+\) Scan parquet", p)) == 1
