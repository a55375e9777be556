"""Operators on ordinary but awkward input: nulls, empty and constant columns,
files whose shapes differ, streams that stop and go on."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators import profile as PR
from kiln.operators import sampling as SM
from kiln.operators.events import first_contact
from kiln.operators.structured import json_long
from kiln.plans import cat_sources, conn_prep, standins
from kiln.plans._q import tables
from kiln.sources import files as FL
from kiln.sources.sinks import snapshot_table
from kiln.streaming import chunks as CH
from tests.conftest import SF001

# ---------------------------------------------------------------- sources

PAGE = {"data": {"after": "t3_x", "children": [{"kind": "t1", "data": {"name": f"n{i}", "created_utc": i, "subreddit": "r", "author": None, "body": "b\nc"}}
                                              for i in range(3)]}}
FIELDS = ["name", "created_utc", "body"]


def test_pretty_printed_listing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PAGE, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([PAGE, PAGE], indent=1))
    got = FL.read_json_listing(spark, str(tmp_path), cat_sources.LISTING_SCHEMA, FIELDS, multi_line=True)
    assert sorted(map(tuple, got.collect())) == sorted([(f"n{i}", i, "b\nc") for i in range(3)] * 3)


def test_a_listing_that_is_not_json_by_line_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PAGE, indent=2))
    with pytest.raises(Exception, match="[Mm]alformed"):
        FL.read_json_listing(spark, str(tmp_path), cat_sources.LISTING_SCHEMA, FIELDS).collect()


@pytest.mark.parametrize("a, b, want", [
    ("tinyint", "int", "int"), ("bigint", "smallint", "bigint"), ("int", "double", "double"), ("float", "bigint", "double"),
    ("decimal(10,2)", "int", "decimal(12,2)"), ("decimal(38,10)", "bigint", "decimal(38,10)"), ("decimal(38,30)", "bigint", "double"), ("date", "timestamp", "timestamp"),
    ("string", "int", "string"), ("boolean", "int", "string"), ("void", "date", "date"), ("array<int>", "array<int>", "array<int>")])
def test_wider_types(spark, a, b, want):
    kind = lambda s: T.StructType.fromDDL(f"c {s}")["c"].dataType
    assert FL.wider(kind(a), kind(b)) == FL.wider(kind(b), kind(a)) == kind(want)


def test_files_with_other_columns_stack_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "x", 1.5)], "id int, `a.b` string, v double").write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(2**40, 7, True)], "id long, v int, extra boolean").write.parquet(f"{tmp_path}/two")
    out = FL.concat_mixed_files(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])
    assert out.dtypes == [("id", "bigint"), ("a.b", "string"), ("v", "double"), ("extra", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(1, "x", 1.5, None), (2**40, None, 7.0, True)]


def test_snapshot_is_read_by_name_and_replaced(spark):
    snapshot_table(spark.range(3), "kiln_test_snapshot")
    assert spark.table("kiln_test_snapshot").count() == 3
    # a second run replaces it, also from itself
    snapshot_table(spark.sql("SELECT id, 'x' AS c FROM kiln_test_snapshot WHERE id > 0"), "kiln_test_snapshot")
    assert sorted(map(tuple, spark.sql("SELECT * FROM kiln_test_snapshot").collect())) == [(1, "x"), (2, "x")]
    spark.sql("DROP TABLE kiln_test_snapshot")


def test_run_history_with_a_null_flag(spark, tmp_path):
    rows = [("R", 1.0), (None, 2.0), ("A", 3.0), (None, 4.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = cat_sources.q_append_run_history(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("1", "A", "1", "3"), ("2", "R", "1", "1"), ("3", None, "2", "6")]


def test_json_members_as_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": null, "c": {"d": [2]}}'), (2, "{}"), (3, None)], "id int, j string")
    assert sorted(map(tuple, json_long(df, "id", "j").collect())) == [(1, "a", "1"), (1, "b", None), (1, "c", '{"d":[2]}')]
    with pytest.raises(Exception, match="[Mm]alformed"):
        json_long(spark.createDataFrame([(1, "{a")], "id int, j string"), "id", "j").collect()


# ---------------------------------------------------------------- streams


def _log(spark, tmp_path, n, name):
    rows = [(f"h{i % 7}", i % 3, float((i * 37) % 101), f"u{i:04d}") for i in range(n)]
    df = spark.createDataFrame(rows, "`id.orig_h` string, `id.resp_p` int, ts double, uid string")
    df.repartition(4).write.mode("append").parquet(f"{tmp_path}/{name}")
    return df


def test_first_contact_on_a_stream_is_that_of_the_batch_also_after_a_restart(spark, tmp_path):
    pair = ["id.orig_h", "id.resp_p"]
    part = _log(spark, tmp_path, 60, "log")
    run = lambda: CH.first_contact_stream(spark, f"{tmp_path}/log", part.schema, pair, "ts", "uid", f"{tmp_path}/sink",
                                          checkpoint=f"{tmp_path}/ckpt", chunk_bytes=1)
    rows = lambda df: sorted(map(tuple, df.select("`id.orig_h`", "`id.resp_p`", "ts", "uid").collect()))
    assert rows(run()) == rows(first_contact(part, pair, "ts", "uid"))
    pieces = len(list((tmp_path / "sink").glob("piece=*")))
    assert pieces > 1  # one file a piece
    _log(spark, tmp_path, 200, "log")  # files that arrive later, earlier contacts among them
    whole = spark.read.parquet(f"{tmp_path}/log")
    assert rows(run()) == rows(first_contact(whole, pair, "ts", "uid"))
    assert len(list((tmp_path / "sink").glob("piece=*"))) > pieces
    assert rows(run()) == rows(first_contact(whole, pair, "ts", "uid"))  # nothing new


def test_chunks_follow_the_bytes_asked_for(spark, tmp_path):
    spark.range(1000).repartition(6).write.parquet(f"{tmp_path}/src")
    schema = spark.range(1).schema
    per = lambda b, i: b.agg(F.sum("id").alias("s")).withColumn("chunk", F.lit(i))
    small = CH.process_in_chunks(spark, f"{tmp_path}/src", schema, per, f"{tmp_path}/small", chunk_bytes=1).collect()
    large = CH.process_in_chunks(spark, f"{tmp_path}/src", schema, per, f"{tmp_path}/large").collect()
    assert (len(small), len(large)) == (6, 1) and sum(r.s for r in small) == sum(r.s for r in large) == 499500


# ---------------------------------------------------------------- profiles


def test_cumulative_bins_on_empty_constant_and_wide_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert PR.cumulative_bins(df, "x").collect() == PR.cumulative_bins(df.limit(0), "x").collect() == []
    one = PR.cumulative_bins(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x").collect()
    assert [tuple(r) for r in one] == [(0, 2.25, 2, 66.67, None)]
    values = [0.1 * i for i in range(77)] + [1.0, 1.25, 500.0]
    got = PR.cumulative_bins(spark.createDataFrame([(v,) for v in values], "x double"), "x", 0.25).orderBy("k").collect()
    assert [r.k for r in got] == list(range(len(got))) and got[-1].bin_right >= 500 > got[-2].bin_right - 0.25
    for r in got:
        assert r.n_le == sum(v <= r.bin_right for v in values)


def test_histogram_of_empty_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, "a")], "x double, label string")
    assert PR.histogram_by_label(df, "x", "label").collect() == PR.histogram_by_label(df.limit(0), "x", "label").collect() == []
    got = PR.histogram_by_label(spark.createDataFrame([(3.0, "a"), (3.0, None)], "x double, label string"), "x", "label").collect()
    assert sorted((r.bin, r.label or "", r.n, r.bin_left) for r in got) == [(0, "", 1, 3.0), (0, "a", 1, 3.0)]


def test_correlations_of_many_columns_from_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    k, n = 120, 400
    x = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 6, k) + 10.0 ** rng.integers(0, 7, k)
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=n)
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 2], x[:, 3] = 0.1, np.nan
    x[0, 4] = math.inf
    cols = [f"c{i}" for i in range(k)]
    data = [tuple(None if math.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(row)) for i, row in enumerate(x)]
    spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols)).repartition(5).write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide")
    out = PR.correlation_pairs(df, cols)
    got = {(r.col_a, r.col_b): r["corr"] for r in out.collect()}
    assert len(got) == k * (k + 1) // 2
    x[0, 4] = np.nan
    for i in range(k):
        for j in range(i + 1):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if {i, j} & {2, 3}:
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") == 1
    assert all(r["corr"] is None for r in PR.correlation_pairs(df.limit(0), cols[:4]).collect())


def test_only_few_valued_columns_are_shuffled(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 20).alias("few"), F.concat(F.lit("v"), F.col("id") % 21).alias("one_more"),
                                  F.md5(F.col("id").cast("string")).alias("many"), F.lit(None).cast("string").alias("none"))
    assert PR.few_valued(df, ["few", "one_more", "many", "none"], 20) == ["few", "one_more", "none"]
    out = PR.unique_value_counts(df, max_distinct=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "many" not in re.sub(r"md5", "", plan) and "md5" not in plan
    got = out.collect()
    assert len(got) == 20 and {r.column_name for r in got} == {"few"} and sum(r.n for r in got) == 5000
    assert PR.unique_value_counts(df.select("many")).collect() == []


# ---------------------------------------------------------------- preparation


def test_connection_chain_on_constant_empty_and_null_logs(spark):
    conn = standins.conn_log(tables(spark, SF001))
    flat = conn.withColumn("orig_bytes", F.lit(7).cast(conn.schema["orig_bytes"].dataType)).withColumn("resp_pkts", F.lit(None).cast(conn.schema["resp_pkts"].dataType))
    out = conn_prep.prepare(flat)
    assert [tuple(r) for r in out.select("orig_bytes", "resp_pkts").distinct().collect()] == [(0.0, 0.0)]
    assert out.count() == conn.count()
    empty = conn_prep.prepare(conn.limit(0))
    assert empty.count() == 0 and "duration" in empty.columns


def test_shuffle_is_seeded_and_follows_its_key(spark):
    df = spark.range(500).select((F.col("id") / 7).alias("x"), "id")
    a, b = ([tuple(r) for r in SM.shuffle_rows(df.repartition(k), ["x", "id"]).collect()] for k in (1, 5))
    assert a == b != sorted(a)
    keys = [r.k for r in SM.shuffle_rows(df, ["x", "id"], key_name="k").collect()]
    assert keys == sorted(keys)
    assert a != [tuple(r) for r in SM.shuffle_rows(df, ["x", "id"], seed=5).collect()]


def test_packed_sort_columns_keep_the_order(spark):
    rng = np.random.default_rng(1)
    cols = [f"f{i}" for i in range(17)]
    data = [tuple([float(rng.integers(3))] + [None if v == 9 else int(v) for v in rng.choice([-128, -1, 0, 1, 127, 9], len(cols))]) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, " + ", ".join(f"{c} tinyint" for c in cols))
    keys = SM.packed_order(df, ["x", *[f"`{c}`" for c in cols]])
    assert len(keys) == 4
    assert [tuple(r) for r in df.orderBy(*keys).collect()] == [tuple(r) for r in df.orderBy("x", *cols).collect()]
