"""Catalog: projections, filters, joins, set operations and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import strings as FS
from kiln.functions.timefn import recent
from kiln.operators import relational as O
from kiln.plans import prevalence as P
from kiln.plans import standins as S
from kiln.plans._q import rounded, tables
from kiln.plans.oracle import EMAIL_CTES, PREV2_SQL, PREV_SQL, PROC_CTES
from kiln.registry import query
from kiln.sources.sinks import snapshot_table

AS_OF = "2001-01-01"  # fixed report date for the recency rules


# ------------------------------------------------------------ prevalence


@query("count_distinct", section="2.4", sql=f"""
WITH {PROC_CTES}
SELECT count(DISTINCT clientguid) AS n_clients FROM digest_system
WHERE customer = 'acme' AND "timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY
""")
def q_count_distinct(spark, sf_dir):
    return P.client_count(tables(spark, sf_dir), "acme", AS_OF, 365)


@query("recent_rows", section="2.6", sql=f"""
WITH {PROC_CTES}
SELECT customer, clientguid, "timestamp" FROM digest_system
WHERE customer = 'acme' AND "timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY
""")
def q_recent_rows(spark, sf_dir):
    ds = S.digest_system(tables(spark, sf_dir))
    return ds.where((F.col("customer") == "acme") & recent("timestamp", AS_OF, 21))


@query("prevalence_report", section="2.4", sql=f"""
WITH {PROC_CTES}, {PREV_SQL}
SELECT * FROM tmp_cust_proc_prev
""")
def q_prevalence_report(spark, sf_dir):
    return P.customer_prevalence(tables(spark, sf_dir)).orderBy(F.desc("customer_prevalence"))


@query("snapshot_table", section="2.1", sql=f"""
WITH {PROC_CTES}, {PREV_SQL}
SELECT * FROM tmp_cust_proc_prev WHERE demeanor = 'NL'
""")
def q_snapshot_table(spark, sf_dir):
    snapshot_table(P.customer_prevalence(tables(spark, sf_dir)), "tmp_cust_proc_prev")
    return spark.table("tmp_cust_proc_prev").where(F.col("demeanor") == "NL")


@query("dedupe_by_group_keys", section="2.4", sql=f"""
WITH {PROC_CTES}, {PREV_SQL}, {PREV2_SQL}
SELECT * FROM tmp_cust_proc_prev2
""")
def q_dedupe_by_group_keys(spark, sf_dir):
    t = tables(spark, sf_dir)
    return P.autostarted(P.customer_prevalence(t), S.digest_scoring(t))


@query("process_prevalence_report", section="2.7", sql=f"""
WITH {PROC_CTES}, {PREV_SQL}, {PREV2_SQL}
SELECT * FROM tmp_cust_proc_prev2 WHERE demeanor = 'NL' ORDER BY filename
""")
def q_process_prevalence_report(spark, sf_dir):
    return P.process_prevalence_report(tables(spark, sf_dir)).orderBy("filename")


@query("join_using_multi_key", section="2.3", sql=f"""
WITH {PROC_CTES}
SELECT lp.pathroot, lp.filename, lp.id, lp.vendorname, lp.demeanor, lp.prevelance
FROM label_process lp JOIN digest_scoring ds ON lp.filename = ds.filename AND lp.pathroot = ds.pathroot
WHERE lp.filename LIKE '%.exe' AND ds."timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY
  AND ds.extraneousattributes ILIKE '%autostart%' AND lp.prevelance >= 1
""")
def q_join_using_multi_key(spark, sf_dir):
    return P.recent_autostart_executables(tables(spark, sf_dir), AS_OF, 365)


@query("filter_like", section="2.2", sql=f"""
WITH {PROC_CTES}
SELECT filename, pathroot, extraneousattributes FROM digest_scoring
WHERE extraneousattributes ILIKE '%autostart%' AND filename LIKE '%.exe'
""")
def q_filter_like(spark, sf_dir):
    ds = S.digest_scoring(tables(spark, sf_dir)).select("filename", "pathroot", "extraneousattributes")
    return O.filter_like(O.filter_like(ds, "extraneousattributes", "%autostart%", case_insensitive=True),
                         "filename", "%.exe")


@query("count_distinct_tuple", section="2.4", sql=f"""
WITH {PROC_CTES}
SELECT count(DISTINCT (filename, pathroot)) AS n_pairs,
       count(DISTINCT (filename, pathroot)) FILTER (WHERE extraneousattributes ILIKE '%autostart%') AS n_pairs_autostart
FROM digest_scoring
""")
def q_count_distinct_tuple(spark, sf_dir):
    ds = S.digest_scoring(tables(spark, sf_dir))
    pair = F.struct("filename", "pathroot")
    auto = F.col("extraneousattributes").ilike("%autostart%")
    return ds.agg(F.countDistinct(pair).alias("n_pairs"),
                  F.countDistinct(F.when(auto, pair)).alias("n_pairs_autostart"))


# ----------------------------------------------------------------- e-mails


@query("email_domain", section="2.6", sql=f"""
WITH {EMAIL_CTES}
SELECT email_id, email,
       CASE WHEN email LIKE '%@%' THEN trim(lower(substr(email, strpos(email, '@') + 1))) END AS email_domain
FROM emails
""")
def q_email_domain(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir))
    return e.select("email_id", "email", FS.email_domain("email").alias("email_domain"))


@query("add_column_default_then_update", section="2.2", sql=f"""
WITH {EMAIL_CTES}
SELECT email_id, email,
       CASE WHEN email LIKE '%@%' THEN trim(lower(substr(email, strpos(email, '@') + 1))) END AS email_domain,
       coalesce(regexp_matches(email, '^[^@]+@[^@]+\\.[^@]{{2,}}$'), false) AS is_valid_email_address
FROM emails
""")
def q_add_column_default_then_update(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir))
    e = O.add_column_default_then_update(e, "email_domain", F.col("email").like("%@%"),
                                         FS.email_domain("email"), None)
    return O.add_column_default_then_update(e, "is_valid_email_address", FS.is_valid_email("email"),
                                            F.lit(True), False)


@query("filter_regex_valid_email", section="2.2", sql=f"""
WITH {EMAIL_CTES}
SELECT email_id, email, regexp_matches(email, '^[^@]+@[^@]+\\.[^@]{{2,}}$') AS is_valid
FROM emails WHERE email IS NOT NULL
""")
def q_filter_regex_valid_email(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir))
    valid = O.filter_regex(e, "email", FS.EMAIL_PATTERN).withColumn("is_valid", F.lit(True))
    invalid = O.filter_regex(e, "email", FS.EMAIL_PATTERN, negate=True).withColumn("is_valid", F.lit(False))
    return valid.unionByName(invalid)


@query("top_domains", section="2.6", sql=f"""
WITH {EMAIL_CTES}
SELECT trim(lower(substr(email, strpos(email, '@') + 1))) AS email_domain, count(*) AS n
FROM emails WHERE email LIKE '%@%' GROUP BY 1 ORDER BY n DESC, email_domain
""")
def q_top_domains(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir)).where(F.col("email").like("%@%"))
    return (e.groupBy(FS.email_domain("email").alias("email_domain")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "email_domain"))


@query("last_two_labels", section="2.6", sql=f"""
WITH {EMAIL_CTES}, d AS (
  SELECT email_id, trim(lower(substr(email, strpos(email, '@') + 1))) AS original FROM emails
  WHERE regexp_matches(email, '^[^@]+@[^@]+\\.[^@]{{2,}}$'))
SELECT email_id, original,
       CASE WHEN len(string_split(original, '.')) <= 2 THEN original
            ELSE array_to_string(list_slice(string_split(original, '.'), -2, -1), '.') END AS top_level_domain
FROM d
""")
def q_last_two_labels(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir)).where(FS.is_valid_email("email"))
    d = e.select("email_id", FS.email_domain("email").alias("original"))
    return d.withColumn("top_level_domain", FS.last_two_labels("original"))


@query("count_rows", section="2.4", sql=f"""
WITH {EMAIL_CTES}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE email LIKE '%@%') AS n_with_at,
       round(count(*) FILTER (WHERE email LIKE '%@%') / count(*), 6) AS share_with_at,
       count(*) FILTER (WHERE regexp_matches(email, '^[^@]+@[^@]+\\.[^@]{{2,}}$')) AS n_valid
FROM emails
""")
def q_count_rows(spark, sf_dir):
    e = S.emails(tables(spark, sf_dir))
    with_at = F.count_if(F.col("email").like("%@%"))
    return rounded(e.agg(F.count(F.lit(1)).alias("n_rows"), with_at.alias("n_with_at"),
                         (with_at / F.count(F.lit(1))).alias("share_with_at"),
                         F.count_if(FS.is_valid_email("email")).alias("n_valid")))


# -------------------------------------------------------- projection & filters


@query("drop_columns", section="2.2", sql="SELECT * EXCLUDE (l_tax, l_shipdate) FROM lineitem")
def q_drop_columns(spark, sf_dir):
    return O.drop_columns(tables(spark, sf_dir).lineitem, ["l_tax", "l_shipdate"])


@query("drop_empty_columns", section="2.2", sql="SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_drop_empty_columns(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("refund"),
        F.when(F.col("o_orderstatus") == "X", F.col("o_orderpriority")).alias("void_reason"))
    return O.drop_empty_columns(o)


@query("select_numeric", section="2.2", sql="SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def q_select_numeric(spark, sf_dir):
    o = tables(spark, sf_dir).orders.withColumn("is_open", F.col("o_orderstatus") == "O")
    return O.select_numeric(o)


@query("rename_columns", section="2.2",
       sql="SELECT c_custkey AS customer_id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer")
def q_rename_columns(spark, sf_dir):
    return O.rename_columns(tables(spark, sf_dir).customer,
                            {"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment",
                             "not_there": "ignored"})


@query("reorder_label_last", section="2.2", sql="SELECT * FROM part")
def q_reorder_label_last(spark, sf_dir):
    df = O.reorder_label_last(tables(spark, sf_dir).part, "p_size")
    assert df.columns[-1] == "p_size"
    return df


@query("cast_schema", section="2.2", sql="""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS SMALLINT) AS p_size, p_retailprice,
       p_type, CAST(p_size > 25 AS TINYINT) AS is_large FROM part
""")
def q_cast_schema(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", "p_size", "p_retailprice", "p_type",
                                          (F.col("p_size") > 25).alias("is_large"))
    return O.cast_schema(p, {"p_partkey": "uint32", "p_size": "uint8", "p_retailprice": "float64",
                             "p_type": "category"}, flags_to_int=["is_large"])


@query("bools_to_ints", section="2.2", sql="""
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS TINYINT) AS is_won,
       CAST(o_orderpriority = '1-URGENT' AS TINYINT) AS is_urgent FROM orders
""")
def q_bools_to_ints(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("is_won"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))
    return O.bools_to_ints(o)


@query("filter_eq_cmp", section="2.2", sql="""
SELECT * FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_nationkey <> 3 AND c_custkey > 9
""")
def q_filter_eq_cmp(spark, sf_dir):
    c = tables(spark, sf_dir).customer
    for col, op, v in [("c_mktsegment", "=", "BUILDING"), ("c_acctbal", ">=", 0),
                       ("c_nationkey", "<>", 3), ("c_custkey", ">", 9)]:
        c = O.filter_compare(c, col, op, v)
    return c


NULLED_LINEITEM_SQL = """
nl AS (SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0.05) AS l_discount,
              nullif(l_tax, 0.02) AS l_tax FROM lineitem)"""


def _nulled_lineitem(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity",
                             F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount"),
                             F.nullif(F.col("l_tax"), F.lit(0.02)).alias("l_tax"))


@query("drop_rows_outside_ranges", section="2.2", sql=f"""
WITH {NULLED_LINEITEM_SQL}
SELECT * FROM nl
WHERE NOT coalesce(l_quantity < 5 OR l_quantity > 45, false)
  AND NOT coalesce(l_discount < 0.01 OR l_discount > 0.09, false)
  AND NOT coalesce(l_tax > 0.07, false)
""")
def q_drop_rows_outside_ranges(spark, sf_dir):
    return O.drop_rows_outside_ranges(_nulled_lineitem(tables(spark, sf_dir)),
                                      {"l_quantity": (5, 45), "l_discount": (0.01, 0.09), "l_tax": (None, 0.07)})


@query("drop_rows_missing", section="2.2", sql=f"""
WITH {NULLED_LINEITEM_SQL}
SELECT * FROM nl WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL
""")
def q_drop_rows_missing(spark, sf_dir):
    return O.drop_rows_missing(_nulled_lineitem(tables(spark, sf_dir)), ["l_discount", "l_tax"])


@query("fill_missing", section="2.2", sql=f"""
WITH {NULLED_LINEITEM_SQL}
SELECT l_orderkey, l_linenumber, l_quantity, coalesce(l_discount, 0) AS l_discount, coalesce(l_tax, 0) AS l_tax FROM nl
""")
def q_fill_missing(spark, sf_dir):
    return O.fill_missing(_nulled_lineitem(tables(spark, sf_dir)), {"l_discount": 0.0, "l_tax": 0.0})


@query("sort_rows", section="2.2", sql=f"""
WITH {NULLED_LINEITEM_SQL}
SELECT * FROM nl ORDER BY l_discount DESC NULLS LAST, l_orderkey, l_linenumber
""")
def q_sort_rows(spark, sf_dir):
    return O.sort_rows(_nulled_lineitem(tables(spark, sf_dir)), ["l_discount", "l_orderkey", "l_linenumber"],
                       [False, True, True])


@query("head_rows", section="2.2", sql="""
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def q_head_rows(spark, sf_dir):
    return O.head_rows(tables(spark, sf_dir).orders, 20, ["o_totalprice", "o_orderkey"], [False, True])


# ----------------------------------------------------------- set operations


@query("union_all", section="2.3", sql="""
SELECT * FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def q_union_all(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return O.union_all(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderpriority") == "1-URGENT"))


@query("distinct_sorted", section="2.3", sql="SELECT DISTINCT p_type FROM part ORDER BY p_type DESC")
def q_distinct_sorted(spark, sf_dir):
    return O.distinct_sorted(tables(spark, sf_dir).part, "p_type")
