"""Distributed algorithms against brute force on small fixtures,
including a hot value holding a third of the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import events as EV
from kiln.operators import joins as J
from kiln.operators import quantiles as QT
from kiln.operators import sampling as SM
from kiln.operators import stats as ST
from kiln.operators.windows import prefix_sums


def _skewed(spark, n=3000, seed=7):
    """A third of the rows hold one value; a few nulls and NaN are ignored."""
    rnd = random.Random(seed)
    vals = [42.0 if i % 3 == 0 else rnd.uniform(-100, 100) for i in range(n)]
    extra = [(n + 1, None), (n + 2, float("nan")), (n + 3, None)]
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)] + extra, "id long, v double"), vals


def test_order_statistics_exact_with_hot_value(spark):
    df, vals = _skewed(spark)
    sv = sorted(vals)
    ranks = [0, 1, 500, 999, 1000, 1500, 2999]
    got = QT.order_statistics(df, {"v": ranks}, buckets=8)["v"]
    assert got == {r: sv[r] for r in ranks}


def test_exact_quantiles_match_numpy_linear(spark):
    df, vals = _skewed(spark)
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = QT.exact_quantiles(df, ["v"], qs, buckets=16)["v"]
    want = np.quantile(np.array(vals), qs)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_global_index_is_a_permutation_in_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = SM.global_index(df, ["k"], "i").collect()
    assert sorted(r["i"] for r in out) == list(range(5000))
    assert all(r["i"] == r["k"] for r in out)


def test_family_rank_and_holm_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"f{i % 5}", rnd.random()) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, fam string, p double")
    got = {r["id"]: r["p_holm"] for r in ST.holm_adjust(df, "p", ["fam"], ["id"]).collect()}
    fams = {}
    for i, f, p in rows:
        fams.setdefault(f, []).append((p, i))
    for f, items in fams.items():
        items.sort()
        m = len(items)
        run = 0.0
        for rank, (p, i) in enumerate(items, start=1):
            run = max(run, (m - rank + 1) * p)
            assert math.isclose(got[i], min(1.0, run), abs_tol=1e-12)


def test_holm_monotone_and_capped(spark):
    df = spark.createDataFrame([(i, "a", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.9])],
                               "id long, fam string, p double")
    out = sorted((r["p"], r["p_holm"]) for r in ST.holm_adjust(df, "p", ["fam"], ["id"]).collect())
    adj = [a for _, a in out]
    assert adj == sorted(adj) and max(adj) <= 1.0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "k long, v long")
    out = {r["k"]: r["v_cum"] for r in prefix_sums(df, [F.col("k")], ["v"]).collect()}
    run = 0
    for k in range(500):
        run += k % 7
        assert out[k] == run


def test_resample_exact_count_and_determinism(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(300)], "id long, x long")
    a = SM.resample_exact(df, 480, ["id"], seed=1)
    b = SM.resample_exact(df, 480, ["id"], seed=1)
    assert a.count() == 480
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_split_disjoint_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    s = SM.train_test_split(df, ["k"], 0.3)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n["train"] + n["test"] == 2000 and 450 < n["test"] < 750


def test_stratified_sample_exact_counts(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else "cold") for i in range(3000)], "id long, c string")
    s = SM.stratified_sample(df, "c", {"hot": 0.1, "cold": 0.25}, ["id"])
    n = {r["c"]: r["count"] for r in s.groupBy("c").count().collect()}
    assert n == {"hot": 100, "cold": 500}


def test_trailing_sum_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "a" if i % 3 == 0 else "b", rnd.uniform(0, 500000), rnd.randint(1, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, pair string, ts double, v long")
    got = {r["id"]: r["s"] for r in EV.trailing_sum(df, ["pair"], "ts", "v", 86400.0, "s").collect()}
    for i, p, ts, _ in rows:
        want = sum(v for _, q, t, v in rows if q == p and ts - 86400 <= t <= ts)
        assert got[i] == want


def test_trailing_sum_of_busy_pairs_ties_and_nulls(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "a", "a", None]), rnd.choice([1, 2, None]), rnd.choice([None, *(86400.0 * k / 4 for k in range(30))]),
             rnd.choice([None, 1, 5, 9])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, `p.x` string, q int, ts double, v long")
    got = {r["id"]: r["s"] for r in EV.trailing_sum(df, ["p.x", "q"], "ts", "v", 86400.0, "s").collect()}
    assert len(got) == len(rows)
    for i, p, q, ts, _ in rows:
        mine = [v for _, p2, q2, t, v in rows if (p2, q2) == (p, q) and v is not None
                and (t is None if ts is None else t is not None and ts - 86400 <= t <= ts)]
        assert got[i] == (sum(mine) if mine else None)
    assert EV.trailing_sum(df.limit(0), ["q"], "ts", "v", 86400.0).count() == 0


def test_trailing_sum_spreads_one_busy_pair(spark):
    # one pair, one day: the work is linear and no task holds the pair
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("pair"), (F.col("id") * 0.25).alias("ts"), F.lit(1).alias("v"), "id")
    out = EV.trailing_sum(df, ["pair"], "ts", "v", 3600.0, "s")
    bad = out.where(F.col("s") != F.least(F.col("id") + 1, F.lit(14401))).count()
    assert bad == 0 and out.count() == n


def test_grouped_prefix_sums_across_partitions(spark):
    from kiln.operators.windows import grouped_prefix_sums
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.randint(-5, 5)) for i in range(900)]
    got = {r["at"]: r["v_cum"] for r in grouped_prefix_sums(spark.createDataFrame(rows, "g string, at int, v long"), ["g"], ["at"], ["v"]).collect()}
    for g, at, _ in rows:
        assert got[at] == sum(v for h, t, v in rows if h == g and t <= at)


def test_first_contact_against_brute_force(spark):
    rows = [(i, f"h{i % 4}", float((i * 37) % 101), f"u{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, host string, ts double, uid string")
    got = {r["host"]: r["uid"] for r in EV.first_contact(df, ["host"], "ts", "uid").collect()}
    for h in {r[1] for r in rows}:
        assert got[h] == min((ts, uid) for _, hh, ts, uid in rows if hh == h)[1]


def test_ip_range_join_against_brute_force(spark):
    ranges = [(a << 24, ((a + 3) << 24) - 1, f"c{a}", a) for a in range(1, 220, 4)]
    rdf = spark.createDataFrame(ranges, "start_ip long, end_ip long, country string, asn long")
    ips = ["8.8.8.8", "10.1.2.3", "192.168.0.1", "300.1.1.1", "77.66.55.44", "223.255.255.255", "1.0.0.0"]
    pts = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id long, ip string")
    got = {r["id"]: r["country"] for r in J.ip_range_join(pts, rdf, "ip").collect()}

    def brute(ip):
        parts = [int(x) for x in ip.split(".")]
        if any(p > 255 for p in parts):
            return None
        n = (parts[0] << 24) | (parts[1] << 16) | (parts[2] << 8) | parts[3]
        if parts[0] in (10, 127, 0) or parts[:2] == [192, 168] or parts[0] >= 224:
            return None
        hit = [c for s, e, c, _ in ranges if s <= n <= e]
        return hit[0] if hit else None
    assert got == {i: brute(ip) for i, ip in enumerate(ips)}


def test_range_sweep_against_brute_force(spark):
    rnd = random.Random(9)
    cuts = sorted(rnd.sample(range(2**32), 60) + [5 << 16, (5 << 16) + 1, 6 << 16, 2**32 - 1])
    ranges = [(a, b - 1 - rnd.randrange(2) * rnd.randrange(b - a), f"r{k}") for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k % 3]
    edges = [x + d for a, b, _ in ranges for x in (a, b) for d in (-1, 0, 1)]
    points = sorted({x for x in edges + [rnd.randrange(2**32) for _ in range(500)] if 0 <= x < 2**32})
    rdf = spark.createDataFrame(ranges, "start_ip long, end_ip long, name string")
    got = {r.addr: r.range and r.range.name for r in J.last_range_at(spark.createDataFrame([(p,) for p in points], "addr long"), rdf).collect()}
    assert got == {p: next((n for a, b, n in ranges if a <= p <= b), None) for p in points}
    assert "Generate" not in rdf._jdf.queryExecution().executedPlan().toString()
    none = J.last_range_at(spark.createDataFrame([], "addr long"), rdf)
    assert none.collect() == [] and J.last_range_at(spark.createDataFrame([(5,)], "addr long"), rdf.limit(0)).collect()[0].range is None


def test_range_sweep_raises_on_overlap(spark):
    for clash in ((10, 300), (100_000, 100_001)):
        rdf = spark.createDataFrame([(5, 200_000), clash], "start_ip long, end_ip long")
        with pytest.raises(Exception, match="ranges overlap"):
            J.last_range_at(spark.createDataFrame([(7,)], "addr long"), rdf).collect()


def test_ip_join_keeps_hot_null_and_odd_points(spark):
    rdf = spark.createDataFrame([(8 << 24, (9 << 24) - 1, "x")], "start_ip long, end_ip long, country string")
    ips = ["8.8.8.8"] * 50 + [None, "", "8.8.8", "8.8.8.8.8", "8.8.8.256", "08.8.8.8", "10.0.0.1", "9.0.0.0", "1e1.2.3.4"]
    got = J.ip_range_join(spark.createDataFrame([(i, ip, 1) for i, ip in enumerate(ips)], "id int, ip string, addr int"), rdf, "ip").collect()
    assert {(r.id, r.country) for r in got} == {(i, "x" if ip in ("8.8.8.8", "08.8.8.8") else None) for i, ip in enumerate(ips)}
    assert len(got) == len(ips)
