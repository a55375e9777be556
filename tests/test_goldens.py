"""Answers printed beside the statistics homework, recomputed from its
CSVs (FIXTURES.md §8). Set KILN_GOLDEN_DIR to their folder; skipped otherwise."""

import os

import pytest
from pyspark.sql import functions as F

from kiln.operators import stats as ST
from tests.conftest import R_DATA

pytestmark = pytest.mark.skipif(not R_DATA or not os.path.isdir(R_DATA), reason="KILN_GOLDEN_DIR not set")


def read(spark, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{R_DATA}/{name}.csv")


def test_websearch3(spark):
    df = read(spark, "websearch3")
    assert df.select("Subject").distinct().count() == 30
    g = {r[0]: r[1] for r in df.groupBy("Engine").agg(F.avg("Searches")).collect()}
    assert round(g["Google"], 2) == 152.67
    r = ST.rm_anova_oneway(df, "Searches", "Engine", "Subject")
    assert round(r["p"], 4) == 0.0564
    pairs = ST.pairwise_z(df, "Searches", "Engine", "Subject", r["ms_error"])
    adj = ST.holm_list([p["p"] for p in pairs])
    assert round(min(adj), 4) == 0.0454
    assert df.select("Effort").distinct().count() == 7


def test_effort_pairs(spark):
    df = read(spark, "websearch3")
    r = ST.rm_anova_oneway(df, "Effort", "Engine", "Subject")
    pairs = ST.pairwise_z(df, "Effort", "Engine", "Subject", r["ms_error"])
    adj = ST.holm_list([p["p"] for p in pairs])
    assert 0.9381 in [round(a, 4) for a in adj]


def test_socialvalue(spark):
    df = read(spark, "socialvalue")
    cells = {(r[0], r[1]): r[2] for r in df.groupBy("Clip", "Social").agg(F.avg("Valued")).collect()}
    assert round(cells[("positive", "Facebook")] - cells[("positive", "Twitter")]) == 10
    rows = ST.rm_anova_twoway(df, "Valued", "Social", "Clip", "Subject")
    inter = [r for r in rows if ":" in r["effect"]][0]
    assert round(inter["p"], 4) == 0.0179
    ms, df_e = rows[0]["ms_error"], rows[0]["df2"]
    n = df.select("Subject").distinct().count()
    ps = []
    for social in ["Facebook", "Twitter"]:
        diff = cells[("positive", social)] - cells[("negative", social)]
        ps.append(ST.t_sf2(diff / (2 * ms / n) ** 0.5, df_e))
    assert [round(p, 6) for p in ps] == [0.000225, 0.594397]


def test_teaser(spark):
    df = read(spark, "teaser")
    liked = {r[0]: r[1] for r in df.groupBy("Teaser").agg(F.sum("Liked")).collect()}
    assert max(liked, key=liked.get) == "action" and liked["action"] == 19
    pos, _ = ST.counterbalance(df, "Subject", "Teaser", "Order")
    assert {r["n"] for r in pos.collect()} == {4}


def test_vocab_ks(spark):
    df = read(spark, "vocab").withColumn("k", F.monotonically_increasing_id())
    rows = ST.ks_exponential(df, "Social", "Vocab", ["k"]).collect()
    ps = {r["Social"]: (ST.kolmogorov_exact_p(int(r["n"]), float(r["d"])), r["d"]) for r in rows}
    low = min(ps, key=lambda k: ps[k][0])
    assert low == "Facebook" and round(ps[low][0], 4) == 0.2734 and round(ps[low][1], 5) == 0.17655
