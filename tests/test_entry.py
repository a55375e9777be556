"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E
from kiln import registry


def test_entry_runs_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0


def test_oracles_belong_to_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(registry.queries()) == 166 and len(registry.oracle_sql()) == 145
    assert set(registry.queries()) <= set(qs)
    assert all(isinstance(v, str) and v.strip() for v in sql.values())


def test_no_query_named_pipeline():
    assert not [k for k in registry.queries() if "pipeline" in k or k.startswith("op")]


def test_queries_pin_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        E.queries()["epoch_to_hour"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
