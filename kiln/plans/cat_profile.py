"""Catalog: profiling and aggregate reports (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import profile as PR
from kiln.operators import relational as O
from kiln.plans._q import rounded, tables
from kiln.registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STR = ["l_returnflag", "l_linestatus"]

PROF_SQL = """
prof AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS l_discount,
                nullif(l_tax, 0.02) AS l_tax, l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus,
                l_extendedprice * (1 - l_discount) AS l_net
         FROM lineitem)"""


def prof(t):
    li = t.lineitem
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount"),
                     F.nullif(F.col("l_tax"), F.lit(0.02)).alias("l_tax"), "l_returnflag",
                     F.nullif(F.col("l_linestatus"), F.lit("O")).alias("l_linestatus"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"))


def _describe_sql(table: str, cols, pcts, strings=()) -> str:
    parts = []
    for c in cols:
        stats = [("count", f"count({c})::DOUBLE"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                 ("min", f"min({c})::DOUBLE")]
        stats += [(f"p{p * 100:.10g}", f"quantile_cont({c}, {p})") for p in pcts]
        stats.append(("max", f"max({c})::DOUBLE"))
        for name, e in stats:
            parts.append(f"SELECT '{c}' AS column_name, '{name}' AS stat, round({e}, 6) AS value, "
                         f"NULL::VARCHAR AS text FROM {table}")
    for c in strings:
        parts.append(f"""SELECT '{c}', s.stat, s.value, s.text FROM (
          SELECT sum(n)::DOUBLE AS cnt, count(*)::DOUBLE AS uniq,
                 arg_min(v, (-n, v)) AS top, max(n)::DOUBLE AS freq
          FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)) g,
          LATERAL (VALUES ('count', g.cnt, NULL::VARCHAR), ('unique', g.uniq, NULL), ('top', NULL, g.top),
                          ('freq', g.freq, NULL)) s(stat, value, text)""")
    return "\nUNION ALL\n".join(parts)


def describe_long(df, cols, pcts, strings=()):
    num = PR.describe_numeric(df, cols, pcts).withColumn("text", F.lit(None).cast("string"))
    if not strings:
        return rounded(num)
    s = PR.describe_strings(df, strings)
    long = s.select("column_name", F.inline(F.array(
        F.struct(F.lit("count").alias("stat"), F.col("count").cast("double").alias("value"),
                 F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("unique").alias("stat"), F.col("unique").cast("double").alias("value"),
                 F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("top").alias("stat"), F.lit(None).cast("double").alias("value"), F.col("top").alias("text")),
        F.struct(F.lit("freq").alias("stat"), F.col("freq").cast("double").alias("value"),
                 F.lit(None).cast("string").alias("text")))))
    return rounded(num.unionByName(long))


@query("describe_table", section="2.4", sql=f"""
WITH {PROF_SQL}
{_describe_sql('prof', NUM, [0.25, 0.5, 0.75], STR)}
""")
def q_describe_table(spark, sf_dir):
    return describe_long(prof(tables(spark, sf_dir)), NUM, [0.25, 0.5, 0.75], STR)


@query("describe_price", section="2.4", sql=_describe_sql("orders", ["o_totalprice"], [0.1, 0.5, 0.9, 0.99]))
def q_describe_price(spark, sf_dir):
    return describe_long(tables(spark, sf_dir).orders, ["o_totalprice"], [0.1, 0.5, 0.9, 0.99])


TEXT_SQL = """
txt AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
               CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'False' END AS c_positive,
               strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
        FROM customer JOIN orders ON o_custkey = c_custkey)"""


def _text_view(t):
    c, o = t.customer, t.orders
    return c.join(o, o.o_custkey == c.c_custkey).select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.col("c_acctbal").cast("string").alias("c_acctbal"),
        F.when(F.col("c_acctbal") > 0, "true").otherwise("False").alias("c_positive"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


def _infer_sql():
    parts = []
    for c in ["c_custkey", "c_name", "c_acctbal", "c_positive", "o_orderdate"]:
        v = f"trim({c})"
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS n,
  count(*) FILTER (WHERE regexp_matches({v}, '^[+-]?\\d+$')) AS n_bigint,
  count(*) FILTER (WHERE regexp_matches({v}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')) AS n_double,
  count(*) FILTER (WHERE regexp_matches({v}, '^\\d{{4}}-\\d\\d-\\d\\d([ T]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?)?$')) AS n_timestamp,
  count(*) FILTER (WHERE lower({v}) IN ('true', 'false')) AS n_boolean FROM txt""")
    body = "\nUNION ALL\n".join(parts)
    return f"""WITH {TEXT_SQL}, w AS ({body})
SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n_boolean = n THEN 'boolean' WHEN n_bigint = n THEN 'bigint'
  WHEN n_double = n THEN 'double' WHEN n_timestamp = n THEN 'timestamp' ELSE 'string' END AS inferred FROM w"""


@query("infer_types", section="2.4", sql=_infer_sql())
def q_infer_types(spark, sf_dir):
    return PR.infer_types(_text_view(tables(spark, sf_dir)))


@query("schema_counts", section="2.4", sql="""
SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
         WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype,
       CAST(count(*) AS INTEGER) AS n_columns
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1
""")
def q_schema_counts(spark, sf_dir):
    return PR.schema_counts(tables(spark, sf_dir).lineitem)


def _missing_sql():
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
             f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS fraction FROM prof" for c in cols]
    return f"WITH {PROF_SQL}, m AS ({' UNION ALL '.join(parts)}) SELECT * FROM m WHERE n_missing > 0"


@query("missing_counts", section="2.4", sql=_missing_sql())
def q_missing_counts(spark, sf_dir):
    return rounded(PR.missing_counts(prof(tables(spark, sf_dir))))


@query("class_balance", section="2.4", sql="""
SELECT l_returnflag AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM lineitem GROUP BY 1
""")
def q_class_balance(spark, sf_dir):
    return rounded(PR.class_balance(tables(spark, sf_dir).lineitem, "l_returnflag"))


@query("win_loss_summary", section="2.4", sql="""
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderstatus = 'O') AS losses,
       count(*) AS total, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS win_ratio
FROM orders
""")
def q_win_loss_summary(spark, sf_dir):
    o = tables(spark, sf_dir).orders.withColumn(
        "won", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2))
    return rounded(PR.win_loss_summary(o, "won"))


@query("class_entropy_log_loss", section="2.4", sql="""
WITH b AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT label, round(n / sum(n) OVER (), 4) AS sh, row_number() OVER (ORDER BY n DESC, label) AS rk,
             count(*) OVER () AS k FROM b),
a AS (SELECT label, CASE WHEN rk = k AND (SELECT sum(sh) FROM s) <> 1.0 THEN sh + (1 - (SELECT sum(sh) FROM s))
                        ELSE sh END AS sh FROM s),
c AS (SELECT sh, floor(sh * 10000) AS cnt FROM a)
SELECT CAST(count(*) AS INTEGER) AS n_classes,
       round(-sum(cnt / (SELECT sum(cnt) FROM c) * ln(sh)) FILTER (WHERE cnt > 0), 6) AS log_loss FROM c
""")
def q_class_entropy_log_loss(spark, sf_dir):
    return rounded(PR.class_entropy_log_loss(tables(spark, sf_dir).lineitem, "l_returnflag"))


UVC_SQL = """
ov AS (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
              CAST(o_custkey AS VARCHAR) AS o_custkey_text FROM orders)"""


def _orders_text(t):
    return t.orders.select("o_orderstatus",
                           F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
                           F.col("o_custkey").cast("string").alias("o_custkey_text"))


def _uvc_sql():
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey_text"]
    parts = [f"SELECT '{c}' AS column_name, coalesce({c}, '_None_') AS value, count(*) AS n FROM ov GROUP BY 2"
             for c in cols]
    return f"""WITH {UVC_SQL}, c AS ({' UNION ALL '.join(parts)})
SELECT * FROM c WHERE column_name IN (
  SELECT column_name FROM c WHERE value <> '_None_' GROUP BY 1 HAVING count(*) <= 10)"""


@query("unique_value_counts", section="2.4", sql=_uvc_sql())
def q_unique_value_counts(spark, sf_dir):
    return PR.unique_value_counts(_orders_text(tables(spark, sf_dir)), max_distinct=10)


@query("nunique_strings", section="2.4", sql=f"""
WITH {UVC_SQL}
SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS n_unique FROM ov
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM ov
UNION ALL SELECT 'o_custkey_text', count(DISTINCT o_custkey_text) FROM ov
""")
def q_nunique_strings(spark, sf_dir):
    return PR.nunique_strings(_orders_text(tables(spark, sf_dir)))


def _per_col(expr_fmt, cols, alias):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, round({expr_fmt.format(c=c)}, 6) AS {alias} FROM prof"
                              for c in cols)


@query("top_variance_columns", section="2.4", sql=f"""
WITH {PROF_SQL}, s AS ({_per_col('stddev_samp({c})', NUM, 'std')})
SELECT * FROM s ORDER BY std DESC, column_name LIMIT 3
""")
def q_top_variance_columns(spark, sf_dir):
    return rounded(PR.top_variance_columns(prof(tables(spark, sf_dir)), 3, NUM))


@query("zscore_extremes", section="2.4", sql=f"""
WITH {PROF_SQL}
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, round((min({c}) - avg({c})) / stddev_pop({c}), 6) AS z_min, "
                    f"round((max({c}) - avg({c})) / stddev_pop({c}), 6) AS z_max FROM prof" for c in NUM)}
""")
def q_zscore_extremes(spark, sf_dir):
    return rounded(PR.zscore_extremes(prof(tables(spark, sf_dir)), NUM))


def _iqr_sql():
    parts = []
    for c in NUM:
        parts.append(f"""SELECT '{c}' AS column_name, round(lo, 6) AS lower, round(hi, 6) AS upper,
  (SELECT count(*) FROM prof WHERE {c} < lo OR {c} > hi) AS n_outliers,
  round(100.0 * (SELECT count(*) FROM prof WHERE {c} < lo OR {c} > hi) / (SELECT count(*) FROM prof), 6) AS pct_outliers
FROM (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM prof))""")
    return f"WITH {PROF_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("iqr_outlier_counts", section="2.4", sql=_iqr_sql())
def q_iqr_outlier_counts(spark, sf_dir):
    return rounded(PR.iqr_outlier_counts(prof(tables(spark, sf_dir)), NUM))


def _corr_sql(lower=True):
    parts = []
    for i, a in enumerate(NUM):
        for j, b in enumerate(NUM):
            if (j <= i) if lower else (j < i):
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM prof")
    return " UNION ALL ".join(parts)


@query("correlation_lower_triangle", section="2.4", sql=f"WITH {PROF_SQL} {_corr_sql(True)}")
def q_correlation_lower_triangle(spark, sf_dir):
    return rounded(PR.correlation_pairs(prof(tables(spark, sf_dir)), NUM))


@query("leakage_pairs", section="2.4", sql=f"""
WITH {PROF_SQL}, c AS ({_corr_sql(False)})
SELECT col_a, col_b, corr, abs(corr) AS abs_corr FROM c ORDER BY abs_corr DESC, col_a, col_b
""")
def q_leakage_pairs(spark, sf_dir):
    return rounded(PR.leakage_pairs(prof(tables(spark, sf_dir)), NUM))


FEATS = ["l_quantity", "l_discount", "l_tax", "l_net"]
FTC_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS corr FROM prof"
                             for c in FEATS)


@query("feature_target_corr", section="2.4", sql=f"""
WITH {PROF_SQL}, c AS ({FTC_SQL}) SELECT feature, corr, abs(corr) AS abs_corr FROM c
""")
def q_feature_target_corr(spark, sf_dir):
    return rounded(PR.feature_target_corr(prof(tables(spark, sf_dir)), "l_extendedprice", FEATS))


@query("top_correlated_features", section="2.4", sql=f"""
WITH {PROF_SQL}, c AS ({FTC_SQL}) SELECT feature, corr, abs(corr) AS abs_corr FROM c
ORDER BY abs_corr DESC, feature LIMIT 2
""")
def q_top_correlated_features(spark, sf_dir):
    return rounded(PR.top_correlated_features(prof(tables(spark, sf_dir)), "l_extendedprice", 2, FEATS))


@query("drop_low_corr_features", section="2.4", sql=f"""
WITH {PROF_SQL}, c AS ({FTC_SQL})
SELECT feature FROM c WHERE abs(corr) >= 0.04 UNION ALL SELECT 'l_extendedprice'
""")
def q_drop_low_corr_features(spark, sf_dir):
    kept = PR.drop_low_corr_features(prof(tables(spark, sf_dir)), "l_extendedprice", 0.04, FEATS)
    return spark.createDataFrame([(c,) for c in kept.columns], "feature string")


@query("reduced_feature_table", section="2.4", sql=f"""
WITH {PROF_SQL}, k AS (SELECT {', '.join(f"abs(corr({c}, l_extendedprice)) >= 0.04 AS {c}" for c in FEATS)} FROM prof)
SELECT {', '.join(f"round(CASE WHEN k.{c} THEN prof.{c} END, 6) AS {c}" for c in FEATS)}, round(l_extendedprice, 6) AS l_extendedprice
FROM prof, k
""")
def q_reduced_feature_table(spark, sf_dir):
    """The table that ``drop_low_corr_features`` leaves; dropped features come
    back as null columns, so that the schema does not depend on the data."""
    kept = PR.drop_low_corr_features(prof(tables(spark, sf_dir)), "l_extendedprice", 0.04, FEATS)
    gone = [c for c in FEATS if c not in kept.columns]
    return rounded(kept.select("*", *[F.lit(None).cast("double").alias(c) for c in gone]))


ZPRICE_SQL = """
z AS (SELECT (o_totalprice - a) / s AS price FROM orders,
             (SELECT avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS s FROM orders))"""


def _zprice(t):
    o = t.orders
    m = o.agg(F.avg("o_totalprice").alias("a"), F.stddev_samp("o_totalprice").alias("s")).first()
    return o.select(((F.col("o_totalprice") - F.lit(m["a"])) / F.lit(m["s"])).alias("price"))


@query("cumulative_price_bins", section="2.4", sql=f"""
WITH RECURSIVE {ZPRICE_SQL},
m AS (SELECT min(price) AS mn, max(price) AS mx, count(*) AS n FROM z),
e(k, r) AS (SELECT 0, mn + 0.25 FROM m UNION ALL SELECT k + 1, r + 0.25 FROM e, m WHERE r + 0.25 <= mx + 0.25)
SELECT CAST(k AS INTEGER) AS k, round(r, 6) AS bin_right, (SELECT count(*) FROM z WHERE price <= r) AS n_le,
       round(round((SELECT count(*) FROM z WHERE price <= r) / n * 100.0, 2), 6) AS pct_rows,
       round(100.0 * abs(r - mn) / (mx - mn), 6) AS pct_range
FROM e, m
""")
def q_cumulative_price_bins(spark, sf_dir):
    return rounded(PR.cumulative_bins(_zprice(tables(spark, sf_dir)), "price", 0.25))


@query("histogram_by_label", section="2.4", sql="""
WITH m AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - mn) / ((mx - mn) / 20)), 19) AS INTEGER) AS bin, l_returnflag AS label,
       count(*) AS n, round(mn + least(floor((l_extendedprice - mn) / ((mx - mn) / 20)), 19) * ((mx - mn) / 20), 6) AS bin_left
FROM lineitem, m GROUP BY 1, 2, 4
""")
def q_histogram_by_label(spark, sf_dir):
    return rounded(PR.histogram_by_label(tables(spark, sf_dir).lineitem, "l_extendedprice", "l_returnflag", 20))


@query("row_change_summary", section="2.4", sql=f"""
WITH {PROF_SQL},
a AS (SELECT count(*) AS n FROM prof WHERE NOT coalesce(l_quantity < 5 OR l_quantity > 45, false))
SELECT (SELECT count(*) FROM prof) AS rows_before, (SELECT n FROM a) AS rows_after,
       round(((SELECT n FROM a) - (SELECT count(*) FROM prof)) * 100.0 / (SELECT count(*) FROM prof), 6) AS pct_change
""")
def q_row_change_summary(spark, sf_dir):
    p = prof(tables(spark, sf_dir))
    return rounded(PR.row_change_summary(p, O.drop_rows_outside_ranges(p, {"l_quantity": (5, 45)})))
