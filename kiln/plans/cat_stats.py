"""Catalog: window-style operators (2.5) and experiment statistics (2.8).

The repeated-measures design is ``lineitem`` seen as an experiment:
subject = supplier, within factors = return flag (3 levels), line status and
discount band (2 x 2), response = quantity; subjects missing a cell are
left out so the design is balanced."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import stats as ST
from kiln.plans._q import rounded, tables
from kiln.registry import query


def balanced(df, subject, factors):
    """Rows of subjects observed in every factor-level combination."""
    levels = df.select(*factors).distinct().count()
    full = (df.groupBy(subject).agg(F.count_distinct(*[F.col(f) for f in factors]).alias("__c"))
            .where(F.col("__c") == levels).select(subject))
    return df.join(full, subject, "left_semi")


def _design(t):
    li = t.lineitem
    return li.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("flag"),
                     F.col("l_linestatus").alias("status"),
                     F.when(F.col("l_discount") >= 0.05, "hi").otherwise("lo").alias("band"),
                     F.col("l_quantity").alias("y"))


def _f_tail_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f) by the midpoint rule: the beta integral with t = 1 - w^2."""
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    w0 = f"sqrt(({d1}) * ({f}) / (({d2}) + ({d1}) * ({f})))"
    w = f"({w0} + (1 - {w0}) * (list_i + 0.5) / 100000)"
    return (f"(SELECT 2 * (1 - {w0}) / 100000 * sum(exp(({a} - 1) * ln(1 - {w} * {w}) + (2 * {b} - 1) * ln({w}) "
            f"+ lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))) FROM range(100000) steps(list_i))")


def _normal_tail_sql(z: str) -> str:
    """P(|Z| > |z|) by the midpoint rule over the next 12 deviations."""
    return (f"(SELECT 2 * 12.0 / 100000 * sum(exp(-0.5 * pow(abs({z}) + 12.0 * (list_i + 0.5) / 100000, 2))) / sqrt(2 * pi()) "
            "FROM range(100000) steps(list_i))")


def _holm_sql(rows: str, columns: str, key: str) -> str:
    """Holm over the rows of a short table with a column p."""
    return f"""
SELECT {columns}, round(p, 6) AS p, round(least(1.0, max((m - rn + 1) * p) OVER (ORDER BY p, {key} ROWS UNBOUNDED PRECEDING)), 6) AS p_holm
FROM (SELECT *, row_number() OVER (ORDER BY p, {key}) AS rn, count(*) OVER () AS m FROM {rows})"""


ONEWAY_SQL = """
WITH d AS (SELECT l_suppkey AS s, l_returnflag AS a, l_quantity AS y FROM lineitem),
full_s AS (SELECT s FROM d GROUP BY s HAVING count(DISTINCT a) = (SELECT count(DISTINCT a) FROM d)),
cells AS (SELECT s, a, avg(y) AS y FROM d WHERE s IN (SELECT s FROM full_s) GROUP BY 1, 2),
gm AS (SELECT avg(y) AS g FROM cells),
ssa AS (SELECT sum(n * (m - g) * (m - g)) AS ss, count(*) AS k FROM (SELECT a, avg(y) AS m, count(*) AS n FROM cells GROUP BY a), gm),
sss AS (SELECT sum(k * (m - g) * (m - g)) AS ss, count(*) AS n FROM (SELECT s, avg(y) AS m, count(*) AS k FROM cells GROUP BY s), gm),
sst AS (SELECT sum((y - g) * (y - g)) AS ss FROM cells, gm),
r AS (SELECT sss.n AS n_subjects, ssa.k AS n_levels, ssa.ss AS ss_factor, sss.ss AS ss_subject,
             sst.ss - ssa.ss - sss.ss AS ss_error, ssa.k - 1 AS df1, (sss.n - 1) * (ssa.k - 1) AS df2 FROM ssa, sss, sst),
q AS (SELECT *, ss_subject / (n_subjects - 1) <= ss_error / df2 AS pooled FROM r)
SELECT n_subjects, n_levels, round(ss_factor, 6) AS ss_factor, round(ss_subject, 6) AS ss_subject,
       round(ss_error, 6) AS ss_error, df1, df2, pooled,
       round(CASE WHEN pooled THEN (ss_subject + ss_error) / ((n_subjects - 1) + df2) ELSE ss_error / df2 END, 6) AS ms_error,
       round((ss_factor / df1) / CASE WHEN pooled THEN (ss_subject + ss_error) / ((n_subjects - 1) + df2)
                                      ELSE ss_error / df2 END, 6) AS f
FROM q
"""

ONEWAY_COLS = ["n_subjects", "n_levels", "ss_factor", "ss_subject", "ss_error", "df1", "df2", "pooled", "ms_error",
               "f"]


def _oneway(spark, sf_dir):
    d = balanced(_design(tables(spark, sf_dir)), "subject", ["flag"])
    return d, ST.rm_anova_oneway(d, "y", "flag", "subject")


@query("rm_anova_oneway", section="2.8", sql=f"""
WITH a AS ({ONEWAY_SQL}) SELECT *, round({_f_tail_sql('f', 'df1', 'df2')}, 6) AS p FROM a
""")
def q_rm_anova_oneway(spark, sf_dir):
    _, r = _oneway(spark, sf_dir)
    return rounded(spark.createDataFrame(
        [tuple(r[c] for c in ONEWAY_COLS) + (ST.f_sf(round(r["f"], 6), r["df1"], r["df2"]),)],
        "n_subjects long, n_levels long, ss_factor double, ss_subject double, ss_error double, df1 long, "
        "df2 long, pooled boolean, ms_error double, f double, p double"))


@query("pairwise_tukey_z", section="2.8", sql=f"""
WITH a AS ({ONEWAY_SQL}),
d AS (SELECT l_suppkey AS s, l_returnflag AS a, l_quantity AS y FROM lineitem),
full_s AS (SELECT s FROM d GROUP BY s HAVING count(DISTINCT a) = (SELECT count(DISTINCT a) FROM d)),
cells AS (SELECT s, a, avg(y) AS y FROM d WHERE s IN (SELECT s FROM full_s) GROUP BY 1, 2),
lv AS (SELECT a, avg(y) AS m, count(*) AS n FROM cells GROUP BY a),
pair AS (SELECT x.a AS level_a, y.a AS level_b, round(x.m - y.m, 6) AS diff,
       round(sqrt(2 * (SELECT ms_error FROM a) / x.n), 6) AS se,
       round((x.m - y.m) / sqrt(2 * (SELECT ms_error FROM a) / x.n), 4) AS z
FROM lv x JOIN lv y ON x.a < y.a),
tail AS (SELECT *, {_normal_tail_sql('z')} AS p FROM pair)
{_holm_sql('tail', 'level_a, level_b, diff, se, z', 'level_a, level_b')}
""")
def q_pairwise_tukey_z(spark, sf_dir):
    d, r = _oneway(spark, sf_dir)
    ms = round(r["ms_error"], 6)  # the oracle carries the rounded mean square
    rows = ST.pairwise_z(d, "y", "flag", "subject", ms)
    ps = [ST.norm_sf2(round(x["z"], 4)) for x in rows]
    df = spark.createDataFrame([(x["level_a"], x["level_b"], x["diff"], x["se"], x["z"], p, h)
                                for x, p, h in zip(rows, ps, ST.holm_list(ps))],
                               "level_a string, level_b string, diff double, se double, z double, p double, p_holm double")
    return rounded(df).withColumn("z", F.round("z", 4))


def _twoway(spark, sf_dir):
    d = balanced(_design(tables(spark, sf_dir)), "subject", ["status", "band"])
    return d, ST.rm_anova_twoway(d, "y", "status", "band", "subject")


TWOWAY_CTES = """
d AS (SELECT l_suppkey AS s, l_linestatus AS a, CASE WHEN l_discount >= 0.05 THEN 'hi' ELSE 'lo' END AS b,
             l_quantity AS y FROM lineitem),
full_s AS (SELECT s FROM d GROUP BY s HAVING count(DISTINCT (a, b)) = (SELECT count(DISTINCT (a, b)) FROM d)),
cells AS (SELECT s, a, b, avg(y) AS y FROM d WHERE s IN (SELECT s FROM full_s) GROUP BY 1, 2, 3),
gm AS (SELECT avg(y) AS g FROM cells),
sa AS (SELECT sum(w * (m - g) * (m - g)) AS ss, count(*) AS l FROM (SELECT a, avg(y) AS m, count(*) AS w FROM cells GROUP BY a), gm),
sb AS (SELECT sum(w * (m - g) * (m - g)) AS ss, count(*) AS l FROM (SELECT b, avg(y) AS m, count(*) AS w FROM cells GROUP BY b), gm),
sab AS (SELECT sum(w * (m - g) * (m - g)) AS ss FROM (SELECT a, b, avg(y) AS m, count(*) AS w FROM cells GROUP BY a, b), gm),
ss_ AS (SELECT sum(w * (m - g) * (m - g)) AS ss, count(*) AS n FROM (SELECT s, avg(y) AS m, count(*) AS w FROM cells GROUP BY s), gm),
st AS (SELECT sum((y - g) * (y - g)) AS ss FROM cells, gm),
e AS (SELECT st.ss - sa.ss - sb.ss - (sab.ss - sa.ss - sb.ss) - ss_.ss AS ss_e, (ss_.n - 1) * (sa.l * sb.l - 1) AS df_e,
             ss_.ss AS ss_s, ss_.n AS n FROM st, sa, sb, sab, ss_),
m AS (SELECT *, ss_s / (n - 1) <= ss_e / df_e AS pooled,
             CASE WHEN ss_s / (n - 1) <= ss_e / df_e THEN (ss_s + ss_e) / ((n - 1) + df_e) ELSE ss_e / df_e END AS ms_err FROM e)"""


@query("rm_anova_twoway", section="2.8", sql=f"""
WITH {TWOWAY_CTES},
eff AS (SELECT 'status' AS effect, sa.ss AS ss, sa.l - 1 AS df1 FROM sa
        UNION ALL SELECT 'band', sb.ss, sb.l - 1 FROM sb
        UNION ALL SELECT 'status:band', sab.ss - sa.ss - sb.ss, (sa.l - 1) * (sb.l - 1) FROM sa, sb, sab),
r AS (SELECT effect, round(ss, 6) AS ss, df1, df_e AS df2, pooled, round(ms_err, 6) AS ms_error,
       round((ss / df1) / ms_err, 6) AS f FROM eff, m)
SELECT *, round({_f_tail_sql('f', 'df1', 'df2')}, 6) AS p FROM r
""")
def q_rm_anova_twoway(spark, sf_dir):
    _, rows = _twoway(spark, sf_dir)
    return rounded(spark.createDataFrame(
        [(r["effect"], r["ss"], r["df1"], r["df2"], r["pooled"], r["ms_error"], r["f"],
          ST.f_sf(round(r["f"], 6), r["df1"], r["df2"])) for r in rows],
        "effect string, ss double, df1 long, df2 long, pooled boolean, ms_error double, f double, p double"))


@query("planned_contrasts_t", section="2.8", sql=f"""
WITH {TWOWAY_CTES},
cm AS (SELECT a, b, avg(y) AS m, count(*) AS n FROM cells GROUP BY a, b),
r AS (SELECT x.a AS status, round(x.m - y.m, 6) AS diff,
       round((x.m - y.m) / sqrt(2 * round((SELECT ms_err FROM m), 6) / x.n), 4) AS t, (SELECT df_e FROM m) AS df
FROM cm x JOIN cm y ON x.a = y.a AND x.b = 'hi' AND y.b = 'lo'),
tail AS (SELECT *, {_f_tail_sql('t * t', '1', 'df')} AS p FROM r)
{_holm_sql('tail', 'status, diff, t, df', 'status')}
""")
def q_planned_contrasts_t(spark, sf_dir):
    d, rows = _twoway(spark, sf_dir)
    ms = round(rows[0]["ms_error"], 6)
    df_e = rows[0]["df2"]
    cm = {(r["status"], r["band"]): (r["m"], r["n"]) for r in
          d.groupBy("subject", "status", "band").agg(F.avg("y").alias("y"))
          .groupBy("status", "band").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for s in sorted({k[0] for k in cm}):
        (mh, n), (ml, _) = cm[(s, "hi")], cm[(s, "lo")]
        diff = mh - ml
        t = diff / (2 * ms / n) ** 0.5
        out.append((s, diff, t, df_e, ST.t_sf2(round(t, 4), df_e)))
    holm = ST.holm_list([r[-1] for r in out])
    return rounded(spark.createDataFrame([(*r, h) for r, h in zip(out, holm)],
                                         "status string, diff double, t double, df long, p double, p_holm double")).withColumn(
        "t", F.round("t", 4))


P_SQL = "((l_discount * 10 + l_tax) / 2)"


@query("holm_adjust", section="2.5", sql=f"""
SELECT l_orderkey, l_linenumber, l_returnflag, round(p, 6) AS p,
       round(least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY l_returnflag ORDER BY p, l_orderkey, l_linenumber
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, {P_SQL} AS p,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY {P_SQL}, l_orderkey, l_linenumber) AS rn,
             count(*) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
""")
def q_holm_adjust(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        ((F.col("l_discount") * 10 + F.col("l_tax")) / 2).alias("p"))
    return rounded(ST.holm_adjust(li, "p", ["l_returnflag"], ["l_orderkey", "l_linenumber"]))


@query("ks_exponential", section="2.5", sql="""
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS x,
                  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS i,
                  count(*) OVER (PARTITION BY l_returnflag) AS n,
                  avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS mu FROM lineitem)
SELECT l_returnflag, n, rate, d,
       (SELECT round(least(1.0, greatest(0.0, sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * n * d * d)))), 6)
        FROM range(1, 101) s(k)) AS p
FROM (SELECT g AS l_returnflag, max(n) AS n, round(1 / max(mu), 9) AS rate,
             round(max(greatest(i / n - (1 - exp(-x / mu)), (1 - exp(-x / mu)) - (i - 1) / n)), 6) AS d FROM r GROUP BY g)
""")
def q_ks_exponential(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    r = ST.ks_exponential(li, "l_returnflag", "l_extendedprice", ["l_orderkey", "l_linenumber"])
    d = r.select("l_returnflag", "n", F.round("rate", 9).alias("rate"), F.round("d", 6).alias("d"))
    return d.withColumn("p", F.round(ST.kolmogorov_limit_p("n", "d"), 6))


@query("ks_exponential_exact", section="2.5")
def q_ks_exponential_exact(spark, sf_dir):
    """Many small samples (one a customer): the exact p, not its limit."""
    o = tables(spark, sf_dir).orders
    r = ST.ks_exponential(o, "o_custkey", "o_totalprice", ["o_orderkey"])
    return ST.with_kolmogorov_p(r)


@query("counterbalance_check", section="2.5", sql="""
WITH r AS (SELECT o_custkey, o_orderpriority AS c,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
pos AS (SELECT 'position' AS kind, CAST(position AS VARCHAR) AS level, c AS condition, count(*) AS n FROM r GROUP BY 2, 3),
pairs AS (SELECT 'predecessor' AS kind, p.c AS level, r.c AS condition, count(*) AS n
          FROM r JOIN r p ON r.o_custkey = p.o_custkey AND r.position = p.position + 1 GROUP BY 2, 3)
SELECT *, min(n) OVER (PARTITION BY kind) = max(n) OVER (PARTITION BY kind) AS balanced
FROM (SELECT * FROM pos UNION ALL SELECT * FROM pairs)
""")
def q_counterbalance_check(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    pos, pairs = ST.counterbalance(o.select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"),
                                   "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])
    a = pos.select(F.lit("position").alias("kind"), F.col("position").cast("string").alias("level"),
                   "condition", "n")
    b = pairs.select(F.lit("predecessor").alias("kind"), F.col("previous").alias("level"), "condition", "n")
    cells = a.unionByName(b)
    # balanced when every cell of a table holds the same count (a small
    # grouped table: one row per kind)
    flag = cells.groupBy("kind").agg((F.min("n") == F.max("n")).alias("balanced"))
    return cells.join(flag, "kind")


@query("ordered_levels", section="2.8", sql="SELECT count(DISTINCT o_orderpriority) AS n_levels FROM orders")
def q_ordered_levels(spark, sf_dir):
    return tables(spark, sf_dir).orders.agg(F.countDistinct("o_orderpriority").alias("n_levels"))


@query("group_mean", section="2.4", sql="""
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1
""")
def q_group_mean(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return rounded(li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean_quantity")))


@query("cell_means", section="2.4", sql="""
WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN m END) - sum(CASE WHEN l_returnflag = 'R' THEN m END) AS d
      FROM c GROUP BY 1)
SELECT c.l_returnflag, c.l_linestatus, round(c.m, 6) AS mean_quantity,
       (SELECT count(DISTINCT sign(d)) FROM s) - 1 AS sign_changes FROM c
""")
def q_cell_means(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    c = li.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("mean_quantity"))
    # traces A vs R across line status: does their order flip? (small grouped table)
    d = (c.groupBy("l_linestatus")
         .agg((F.sum(F.when(F.col("l_returnflag") == "A", F.col("mean_quantity")))
               - F.sum(F.when(F.col("l_returnflag") == "R", F.col("mean_quantity")))).alias("d")))
    flips = d.agg((F.countDistinct(F.signum("d")) - 1).alias("sign_changes")).first()["sign_changes"]
    return rounded(c).withColumn("sign_changes", F.lit(flips).cast("long"))


@query("group_sum", section="2.4", sql="""
SELECT l_returnflag, sum(l_quantity) AS total_quantity FROM lineitem GROUP BY 1
""")
def q_group_sum(spark, sf_dir):
    return tables(spark, sf_dir).lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total_quantity"))


@query("best_per_metric", section="2.5", sql="""
WITH cv AS (SELECT l_returnflag AS metric, l_linenumber AS params, avg(l_discount) AS mean_score,
                   stddev_samp(l_discount) AS std_score FROM lineitem GROUP BY 1, 2)
SELECT metric, arg_max(params, (mean_score, -params)) AS params, round(max(mean_score), 6) AS mean_score,
       round(arg_max(std_score, (mean_score, -params)), 6) AS std_score
FROM cv GROUP BY metric
""")
def q_best_per_metric(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    cv = li.groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("params")).agg(
        F.avg("l_discount").alias("mean_score"), F.stddev_samp("l_discount").alias("std_score"))
    best = F.max_by(F.struct("params", "mean_score", "std_score"), F.struct("mean_score", -F.col("params")))
    return rounded(cv.groupBy("metric").agg(best.alias("b")).select(
        "metric", "b.params", "b.mean_score", "b.std_score"))


HISTORY_SQL = """
h AS (SELECT CAST(day(ts) AS INTEGER) AS epoch,
             avg(value) FILTER (WHERE user_id % 2 = 0) / 100 AS loss,
             avg(value) FILTER (WHERE user_id % 2 = 1) / 100 AS val_loss,
             avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) FILTER (WHERE user_id % 2 = 0) AS accuracy,
             avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) FILTER (WHERE user_id % 2 = 1) AS val_accuracy
      FROM events GROUP BY 1),
g AS (SELECT *, abs(val_loss - loss) AS loss_gap, abs(val_accuracy - accuracy) AS acc_gap FROM h)"""


@query("epoch_gap_topk", section="2.5", sql=f"""
WITH {HISTORY_SQL}
SELECT * FROM (SELECT 'smallest_gap' AS report, epoch, round(loss_gap, 6) AS loss_gap, round(acc_gap, 6) AS acc_gap,
                      round(val_accuracy, 6) AS val_accuracy FROM g ORDER BY loss_gap, epoch LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'best_accuracy', epoch, round(loss_gap, 6), round(acc_gap, 6), round(val_accuracy, 6)
               FROM g ORDER BY val_accuracy DESC, epoch LIMIT 10)
""")
def q_epoch_gap_topk(spark, sf_dir):
    e = tables(spark, sf_dir).events
    even, odd = F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1
    bought = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    h = e.groupBy(F.dayofmonth("ts").alias("epoch")).agg(
        (F.avg(F.when(even, F.col("value"))) / 100).alias("loss"),
        (F.avg(F.when(odd, F.col("value"))) / 100).alias("val_loss"),
        F.avg(F.when(even, bought)).alias("accuracy"), F.avg(F.when(odd, bought)).alias("val_accuracy"))
    g = h.withColumn("loss_gap", F.abs(F.col("val_loss") - F.col("loss"))).withColumn(
        "acc_gap", F.abs(F.col("val_accuracy") - F.col("accuracy")))
    cols = ["epoch", "loss_gap", "acc_gap", "val_accuracy"]
    small = g.orderBy("loss_gap", "epoch").limit(20).select(F.lit("smallest_gap").alias("report"), *cols)
    best = g.orderBy(F.desc("val_accuracy"), "epoch").limit(10).select(F.lit("best_accuracy").alias("report"), *cols)
    return rounded(small.unionByName(best))
