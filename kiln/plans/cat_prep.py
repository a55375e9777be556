"""Catalog: feature preparation, sampling and the composed chains (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.net import RESERVED_IPV4_BLOCKS
from kiln.operators import prep as P
from kiln.operators import relational as O
from kiln.operators import sampling as SM
from kiln.plans import conn_prep as CP
from kiln.plans import sales as SL
from kiln.plans import standins as S
from kiln.plans._q import rounded, tables
from kiln.plans.oracle import CONN_CTE
from kiln.registry import query


def _conn(spark, sf_dir):
    return S.conn_log(tables(spark, sf_dir))


def _r(x):
    return f"round({x}, 6)"


# ------------------------------------------------------------ simple prep

@query("winsorize_low", section="2.7", sql=f"""
WITH {CONN_CTE} SELECT uid, CASE WHEN orig_bytes < 500 THEN 500 ELSE orig_bytes END AS orig_bytes FROM conn
""")
def q_winsorize_low(spark, sf_dir):
    return P.winsorize_low(_conn(spark, sf_dir).select("uid", "orig_bytes"), "orig_bytes", 500)


@query("winsorize_high", section="2.7", sql=f"""
WITH {CONN_CTE} SELECT uid, CASE WHEN orig_bytes > 30000 THEN 30000 ELSE orig_bytes END AS orig_bytes FROM conn
""")
def q_winsorize_high(spark, sf_dir):
    return P.winsorize_high(_conn(spark, sf_dir).select("uid", "orig_bytes"), "orig_bytes", 30000)


@query("winsorize_columns", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, CASE WHEN orig_bytes < 500 THEN 500 WHEN orig_bytes > 30000 THEN 30000 ELSE orig_bytes END AS orig_bytes,
       CASE WHEN resp_bytes < 200 THEN 200 WHEN resp_bytes > 10000 THEN 10000 ELSE resp_bytes END AS resp_bytes,
       {_r('CASE WHEN duration < 1 THEN 1 WHEN duration > 30 THEN 30 ELSE duration END')} AS duration FROM conn
""")
def q_winsorize_columns(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "orig_bytes", "resp_bytes", "duration")
    return rounded(P.winsorize_columns(c, {"orig_bytes": 500, "resp_bytes": 200, "duration": 1},
                                       {"orig_bytes": 30000, "resp_bytes": 10000, "duration": 30}))


@query("clip_upper", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, least(missed_bytes, 25000) AS missed_bytes, least(resp_pkts, 100) AS resp_pkts,
       least(resp_ip_bytes, 7500) AS resp_ip_bytes FROM conn
""")
def q_clip_upper(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "missed_bytes", "resp_pkts", "resp_ip_bytes")
    return P.clip_upper(c, CP.CLIP_UPPER)


@query("minmax_relative", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, {_r('(orig_bytes - min(orig_bytes) OVER ()) / nullif(max(orig_bytes) OVER () - min(orig_bytes) OVER (), 0)')} AS orig_bytes,
       {_r('(duration - min(duration) OVER ()) / nullif(max(duration) OVER () - min(duration) OVER (), 0)')} AS duration
FROM conn
""")
def q_minmax_relative(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "orig_bytes", "duration")
    return rounded(P.minmax_relative(c, ["orig_bytes", "duration"]))


HOUR_SQL = "(((floor(ts / 3600) % 24 + (floor(ts / 60) % 60) / 60.0) - 18) % 24 + 24) % 24"


@query("minmax_fixed", section="2.7", sql=f"""
WITH {CONN_CTE} SELECT uid, {_r(f'({HOUR_SQL} - 0) / 23')} AS hour_of_day FROM conn
""")
def q_minmax_fixed(spark, sf_dir):
    from kiln.functions.timefn import epoch_to_hour, shift_hour
    c = _conn(spark, sf_dir).select("uid", shift_hour(epoch_to_hour("ts"), -18).alias("hour_of_day"))
    return rounded(P.minmax_fixed(c, {"hour_of_day": (0, 23)}))


@query("zscore_sample", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, {_r('(orig_bytes - avg(orig_bytes) OVER ()) / stddev_samp(orig_bytes) OVER ()')} AS orig_bytes,
       {_r('(duration - avg(duration) OVER ()) / stddev_samp(duration) OVER ()')} AS duration FROM conn
""")
def q_zscore_sample(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "orig_bytes", "duration")
    return rounded(P.zscore_sample(c, ["orig_bytes", "duration"]))


@query("zscore_population", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, {_r('(orig_bytes - avg(orig_bytes) OVER ()) / stddev_pop(orig_bytes) OVER ()')} AS orig_bytes,
       {_r('(resp_bytes - avg(resp_bytes) OVER ()) / stddev_pop(resp_bytes) OVER ()')} AS resp_bytes,
       CAST(NULL AS DOUBLE) AS duration FROM conn
""")
def q_zscore_population(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "orig_bytes", "resp_bytes", "duration")
    return rounded(P.zscore_population(c, ["orig_bytes", "resp_bytes", "duration"]))


SPLIT_SQL = "('0x' || substr(md5('123456:' || uid), 1, 8))::BIGINT / 4294967296.0"


@query("train_test_split", section="2.7", sql=f"""
WITH {CONN_CTE} SELECT uid, CASE WHEN {SPLIT_SQL} < 0.3 THEN 'test' ELSE 'train' END AS split FROM conn
""")
def q_train_test_split(spark, sf_dir):
    return SM.train_test_split(_conn(spark, sf_dir).select("uid"), ["uid"], 0.3)


@query("standard_scale", section="2.7", sql=f"""
WITH {CONN_CTE},
tr AS (SELECT avg(orig_bytes) AS m, stddev_pop(orig_bytes) AS s FROM conn WHERE NOT ({SPLIT_SQL} < 0.3))
SELECT uid, {_r('(orig_bytes - m) / s')} AS orig_bytes FROM conn, tr
""")
def q_standard_scale(spark, sf_dir):
    c = SM.train_test_split(_conn(spark, sf_dir).select("uid", "orig_bytes"), ["uid"], 0.3)
    scaler = P.PopulationScaler(["orig_bytes"]).fit(c.where(F.col("split") == "train"))
    return rounded(scaler.transform(c).select("uid", "orig_bytes"))


@query("one_hot", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, CAST(coalesce(proto = 'icmp', false) AS TINYINT) AS proto_icmp,
       CAST(coalesce(proto = 'tcp', false) AS TINYINT) AS proto_tcp,
       CAST(coalesce(proto = 'udp', false) AS TINYINT) AS proto_udp FROM conn
""")
def q_one_hot(spark, sf_dir):
    return P.one_hot(_conn(spark, sf_dir).select("uid", "proto"), "proto")


@query("one_hot_columns", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, CAST(coalesce(service = 'http', false) AS TINYINT) AS service_http,
       CAST(coalesce(service = 'ssl', false) AS TINYINT) AS service_ssl,
       CAST(coalesce(proto = 'icmp', false) AS TINYINT) AS proto_icmp,
       CAST(coalesce(proto = 'tcp', false) AS TINYINT) AS proto_tcp,
       CAST(coalesce(proto = 'udp', false) AS TINYINT) AS proto_udp FROM conn
""")
def q_one_hot_columns(spark, sf_dir):
    return P.one_hot_columns(_conn(spark, sf_dir).select("uid", "service", "proto"), ["service", "proto"])


def _winsor_pct_sql(src: str, cols, alias_rest: str) -> str:
    sel = []
    for c in cols:
        lo = (f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS rk FROM {src} "
              f"WHERE {c} IS NOT NULL) WHERE rk = (SELECT floor(0.05 * count({c})) FROM {src}))")
        hi = (f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS rk FROM {src} "
              f"WHERE {c} IS NOT NULL) WHERE rk = (SELECT count({c}) - floor(0.05 * count({c})) - 1 FROM {src}))")
        sel.append(f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}")
    return f"SELECT {alias_rest}, {', '.join(sel)} FROM {src}"


@query("winsorize_percent", section="2.5", sql=f"""
WITH {CONN_CTE}, f AS (SELECT uid, coalesce(duration, 0) AS duration, orig_pkts, orig_ip_bytes FROM conn),
w AS ({_winsor_pct_sql('f', ['duration', 'orig_pkts', 'orig_ip_bytes'], 'uid')})
SELECT uid, round(duration, 6) AS duration, orig_pkts, orig_ip_bytes FROM w
""")
def q_winsorize_percent(spark, sf_dir):
    c = O.fill_missing(_conn(spark, sf_dir).select("uid", "duration", "orig_pkts", "orig_ip_bytes"), {"duration": 0})
    return rounded(P.winsorize_percent(c, ["duration", "orig_pkts", "orig_ip_bytes"], (0.05, 0.05)))


# ---------------------------------------------------------------- sampling

def _draws_sql(src: str, order: str, n_expr: str, seed: int = 123456) -> str:
    """Rows of ``src`` drawn with replacement: draw i picks position
    md5('seed:i') mod n of ``src`` in ``order`` order."""
    return f"""(SELECT s.* EXCLUDE (__idx) FROM
      (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS __idx FROM {src}) s
      JOIN (SELECT ('0x' || substr(md5('{seed}:' || CAST(i AS VARCHAR)), 1, 8))::BIGINT
                   % (SELECT count(*) FROM {src}) AS __idx
            FROM (SELECT unnest(range(CAST({n_expr} AS BIGINT))) AS i)) d USING (__idx))"""


LABELLED_SQL = f"""
lab AS (SELECT uid, orig_bytes, NOT coalesce(label IN ('Benign'), false) AS is_malware FROM conn),
maj AS (SELECT * FROM lab WHERE NOT is_malware), mino AS (SELECT * FROM lab WHERE is_malware)"""


def _labelled(spark, sf_dir):
    c = _conn(spark, sf_dir)
    return c.select("uid", "orig_bytes", O.label_not_in("label", ["Benign"]).alias("is_malware"))


@query("downsample_to_match", section="2.7", sql=f"""
WITH {CONN_CTE}, {LABELLED_SQL}
SELECT * FROM {_draws_sql('maj', 'uid', '(SELECT count(*) FROM mino)')}
UNION ALL SELECT * FROM mino
""")
def q_downsample_to_match(spark, sf_dir):
    return SM.downsample_to_match(_labelled(spark, sf_dir), "is_malware", False, True, order_cols=["uid"])


@query("upsample_to_match", section="2.7", sql=f"""
WITH {CONN_CTE}, {LABELLED_SQL}
SELECT * FROM {_draws_sql('mino', 'uid', '(SELECT count(*) FROM maj)')}
UNION ALL SELECT * FROM maj
""")
def q_upsample_to_match(spark, sf_dir):
    return SM.upsample_to_match(_labelled(spark, sf_dir), "is_malware", True, False, order_cols=["uid"])


@query("shuffle_rows", section="2.7", sql=f"""
WITH {CONN_CTE}
SELECT uid, orig_bytes FROM conn ORDER BY ('0x' || substr(md5('123456:' || uid), 1, 15))::BIGINT, uid
""")
def q_shuffle_rows(spark, sf_dir):
    return SM.shuffle_rows(_conn(spark, sf_dir).select("uid", "orig_bytes"), ["uid"])


@query("stratified_sample", section="2.10", sql=f"""
WITH {CONN_CTE},
h AS (SELECT uid, proto, ('0x' || substr(md5('123456:' || uid), 1, 13))::BIGINT AS hv FROM conn),
r AS (SELECT *, row_number() OVER (PARTITION BY proto ORDER BY hv) AS rn, count(*) OVER (PARTITION BY proto) AS n FROM h)
SELECT uid, proto FROM r
WHERE rn <= floor(CASE proto WHEN 'tcp' THEN 0.1 WHEN 'udp' THEN 0.2 WHEN 'icmp' THEN 0.5 END * n)
""")
def q_stratified_sample(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "proto")
    return SM.stratified_sample(c, "proto", {"tcp": 0.1, "udp": 0.2, "icmp": 0.5}, ["uid"])


# ---------------------------------------------------------- trainability

@query("assert_trainable", section="2.7", sql="""
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem
""")
def q_assert_trainable(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return P.assert_trainable(li)


CONN_TYPES = [("ts", "double"), ("uid", "string"), ("id.orig_h", "string"), ("id.orig_p", "int"),
              ("id.resp_h", "string"), ("id.resp_p", "int"), ("proto", "string"), ("service", "string"),
              ("duration", "double"), ("orig_bytes", "bigint"), ("resp_bytes", "bigint"), ("missed_bytes", "bigint"),
              ("orig_pkts", "bigint"), ("orig_ip_bytes", "bigint"), ("resp_pkts", "bigint"),
              ("resp_ip_bytes", "bigint"), ("tunnel_parents", "string"), ("label", "string")]


def _trainable_sql():
    parts = []
    for c, t in CONN_TYPES:
        ok = "true" if t not in ("string",) else "false"
        parts.append(f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE "{c}" IS NULL) AS n_null,
  count(*) FILTER (WHERE "{c}" IS NULL) = 0 AND {ok} AS ready FROM conn""")
    return f"WITH {CONN_CTE}\n" + "\nUNION ALL\n".join(parts)


@query("trainable_report", section="2.7", sql=_trainable_sql())
def q_trainable_report(spark, sf_dir):
    return P.trainable_report(_conn(spark, sf_dir))


# ------------------------------------------------------------------ sales

OPPS_SQL = """
opps AS (
  SELECT 'OPP-' || CAST(o_orderkey AS VARCHAR) AS "CRM Identifier", c_mktsegment AS "Industry",
         'REP' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS "Sales Rep ID",
         CASE WHEN c_nationkey = 24 THEN NULL ELSE r_name || ' - ' || n_name END AS "Sales team name",
         month(o_orderdate) % 8 AS "Num times opp pushed", dayofyear(o_orderdate) * 2 AS "Age of opp in days",
         CASE WHEN c_acctbal < -900 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS "Deal size (USD)",
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS "Won",
         quarter(o_orderdate) AS quarter_created,
         ((quarter(o_orderdate) + o_custkey % 3 - 1) % 4 + 4) % 4 + 1 AS quarter_closed,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'managed_service|A|' WHEN '2-HIGH' THEN 'product|B|saas_platform'
              WHEN '3-MEDIUM' THEN 'product|C|on_prem' WHEN '4-NOT SPECIFIED' THEN '' END AS primary_product,
         c_acctbal > 5000 AS partner_involved
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
clean AS (
  SELECT "Industry", "Sales Rep ID", "Sales team name", "Num times opp pushed", "Age of opp in days",
         "Deal size (USD)", "Won", quarter_created, quarter_closed, partner_involved,
         nullif(split_part(primary_product, '|', 1), '') AS positioning_category,
         nullif(split_part(primary_product, '|', 2), '') AS product_family,
         nullif(split_part(primary_product, '|', 3), '') AS hosting_location,
         nullif(regexp_extract("Sales team name", '([^\\s]+)', 1), '') AS sales_territory
  FROM opps
  WHERE NOT coalesce(quarter_created < 1 OR quarter_created > 4, false)
    AND NOT coalesce(quarter_closed < 1 OR quarter_closed > 4, false)
    AND NOT coalesce("Age of opp in days" < 14 OR "Age of opp in days" > 720, false)
    AND NOT coalesce("Deal size (USD)" < 1500 OR "Deal size (USD)" > 1000000, false))"""

# The level domains of the driver tables the opportunities
# come from (5 segments, 40 reps, 24 named teams, product parts, regions).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
LEVELS = {
    "Industry": SEGMENTS,
    "Sales Rep ID": [f"REP{i:02d}" for i in range(40)],
    "Sales team name": sorted(f"{REGIONS[i % 5]} - NATION_{i}" for i in range(24)),
    "positioning_category": ["managed_service", "product"],
    "product_family": ["A", "B", "C"],
    "hosting_location": ["on_prem", "saas_platform"],
    "sales_territory": sorted({r.split(" ")[0] for r in REGIONS}),
}


def _clip(c, lo, hi):
    return f'CASE WHEN "{c}" < {lo} THEN {lo} WHEN "{c}" > {hi} THEN {hi} ELSE "{c}" END'


def _sales_prepped_sql():
    num = []
    for c in SL.FIXED_RANGE_COLUMNS:
        lo, hi = SL.WINSOR_MIN[c], SL.WINSOR_MAX[c]
        num.append(f'round(({_clip(c, lo, hi)} - {lo}) / {hi - lo}, 6) AS "{c}"')
    flags = []
    for c, levels in LEVELS.items():
        for v in levels:
            flags.append(f"""CAST(coalesce("{c}" = '{v}', false) AS TINYINT) AS "{c}_{v}" """)
    return f"""{OPPS_SQL},
prepped AS (
  SELECT {', '.join(num)}, CAST("Won" AS TINYINT) AS "Won", CAST(partner_involved AS TINYINT) AS partner_involved,
         {', '.join(flags)}
  FROM clean WHERE "Sales Rep ID" IS NOT NULL AND "Sales team name" IS NOT NULL
    AND "Age of opp in days" IS NOT NULL AND "Won" IS NOT NULL AND "Deal size (USD)" IS NOT NULL)"""


def _opps(spark, sf_dir):
    return S.opportunities(tables(spark, sf_dir))


def _sales_levels():
    return {c: list(v) for c, v in LEVELS.items()}


@query("sales_clean_load", section="2.7", sql=f"WITH {OPPS_SQL} SELECT * FROM clean")
def q_sales_clean_load(spark, sf_dir):
    return SL.clean_load(_opps(spark, sf_dir))


@query("sales_prep_chain", section="2.7", sql=f"WITH {_sales_prepped_sql()} SELECT * FROM prepped")
def q_sales_prep_chain(spark, sf_dir):
    return rounded(SL.prepare(_opps(spark, sf_dir)))


def _upsample_sql():
    cols = ['"' + c + '"' for c in SL.FIXED_RANGE_COLUMNS] + ['"Won"', "partner_involved"]
    cols += ['"' + f"{c}_{v}" + '"' for c, lv in LEVELS.items() for v in lv]
    order = ", ".join(cols)
    return f"""WITH {_sales_prepped_sql()},
pos AS (SELECT * FROM prepped WHERE "Won" = 1)
SELECT * FROM {_draws_sql('pos', order, 'floor((SELECT count(*) FROM pos) * 1.6)')}
UNION ALL SELECT * FROM prepped WHERE NOT ("Won" = 1) OR "Won" IS NULL"""


@query("upsample_class", section="2.7", sql=_upsample_sql())
def q_upsample_class(spark, sf_dir):
    prepped = rounded(SL.prepare(_opps(spark, sf_dir)))
    order = (SL.FIXED_RANGE_COLUMNS + ["Won", "partner_involved"]
             + [f"{c}_{v}" for c, lv in LEVELS.items() for v in lv])
    return SM.upsample_class(prepped, "Won", positive=1, factor=1.6, order_cols=[f"`{c}`" for c in order])


@query("sales_training_chain", section="2.7", sql=_upsample_sql())
def q_sales_training_chain(spark, sf_dir):
    """The whole chain, upsampling and trainability check included."""
    order = (SL.FIXED_RANGE_COLUMNS + ["Won", "partner_involved"]
             + [f"{c}_{v}" for c, lv in LEVELS.items() for v in lv])
    return SL.prepare_for_training(_opps(spark, sf_dir), order_cols=order, prepared=rounded)


# ------------------------------------------------------- connection chains

def _conn_base_sql():
    return f"""
b AS (SELECT coalesce(duration, 0) AS duration, coalesce(orig_bytes, 0) AS orig_bytes,
             coalesce(resp_bytes, 0) AS resp_bytes, coalesce(missed_bytes, 0) AS missed_bytes,
             coalesce(resp_ip_bytes, 0) AS resp_ip_bytes, coalesce(resp_pkts, 0) AS resp_pkts,
             coalesce(orig_pkts, 0) AS orig_pkts, coalesce(orig_ip_bytes, 0) AS orig_ip_bytes,
             "id.resp_p", NOT coalesce(label IN ('Benign'), false) AS is_IoT_malware,
             ({HOUR_SQL} - 0) / 23 AS hour_of_day,
             CAST(CASE WHEN "id.orig_p" BETWEEN 1 AND 1023 THEN 0 WHEN "id.orig_p" BETWEEN 1024 AND 49151 THEN 1
                       WHEN "id.orig_p" BETWEEN 49152 AND 65535 THEN 2 ELSE 3 END AS TINYINT) AS src_port_range_name,
             CAST(coalesce(service = 'http', false) AS TINYINT) AS service_http,
             CAST(coalesce(service = 'ssl', false) AS TINYINT) AS service_ssl,
             CAST(coalesce(proto = 'icmp', false) AS TINYINT) AS proto_icmp,
             CAST(coalesce(proto = 'tcp', false) AS TINYINT) AS proto_tcp,
             CAST(coalesce(proto = 'udp', false) AS TINYINT) AS proto_udp
      FROM conn),
w AS ({_winsor_pct_sql('b', ['duration', 'orig_pkts', 'orig_ip_bytes'],
                       'orig_bytes, resp_bytes, missed_bytes, resp_ip_bytes, resp_pkts, "id.resp_p", is_IoT_malware, '
                       'hour_of_day, src_port_range_name, service_http, service_ssl, proto_icmp, proto_tcp, proto_udp')}),
c AS (SELECT * REPLACE (least(missed_bytes, 25000) AS missed_bytes, least(resp_pkts, 100) AS resp_pkts,
                        least(resp_ip_bytes, 7500) AS resp_ip_bytes) FROM w)"""


SCALED = ["duration", "orig_pkts", "orig_ip_bytes", "orig_bytes", "resp_bytes", "missed_bytes", "resp_pkts", "resp_ip_bytes"]


def _conn_prep_sql():
    z = [f"round(({col} - avg({col}) OVER ()) / stddev_pop({col}) OVER (), 6) AS {col}" for col in SCALED]
    return f"""WITH {CONN_CTE}, {_conn_base_sql()}
SELECT {', '.join(z)}, "id.resp_p", CAST(is_IoT_malware AS TINYINT) AS is_IoT_malware, round(hour_of_day, 6) AS hour_of_day,
       src_port_range_name, service_http, service_ssl, proto_icmp, proto_tcp, proto_udp FROM c"""


@query("conn_prep_chain", section="2.7", sql=_conn_prep_sql())
def q_conn_prep_chain(spark, sf_dir):
    return rounded(CP.prepare(_conn(spark, sf_dir)))


FLAGS = ["service_http", "service_ssl", "proto_icmp", "proto_tcp", "proto_udp"]
CONN_FEATURES = sorted([*SCALED, "id.resp_p", "hour_of_day", "src_port_range_name", *FLAGS])


def _conn_training_sql():
    """Features below the threshold are null; a row's key hashes the others
    (fractions as whole millionths) and the label."""
    z = [f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in SCALED]
    kept = {c: f'CASE WHEN k."{c}" THEN p."{c}" END' for c in CONN_FEATURES}
    whole = {c: c not in SCALED and c != "hour_of_day" for c in CONN_FEATURES}
    spelled = [f"CAST({kept[c]} AS VARCHAR)" if whole[c] else f"CAST(CAST(round({kept[c]} * 1000000) AS BIGINT) AS VARCHAR)" for c in CONN_FEATURES]
    shown = [f'{kept[c]} AS "{c}"' if whole[c] else f'round({kept[c]}, 6) AS "{c}"' for c in CONN_FEATURES]
    return f"""WITH {CONN_CTE}, {_conn_base_sql()},
p AS (SELECT {', '.join(z)}, "id.resp_p", CAST(is_IoT_malware AS TINYINT) AS is_IoT_malware, hour_of_day,
        src_port_range_name, {', '.join(FLAGS)} FROM c),
k AS (SELECT {', '.join(f'coalesce(abs(corr("{c}", is_IoT_malware)) >= 0.04, false) AS "{c}"' for c in CONN_FEATURES)} FROM p)
SELECT {', '.join(shown)}, is_IoT_malware,
  ('0x' || substr(md5(concat_ws(':', '123456', {', '.join(spelled)}, CAST(is_IoT_malware AS VARCHAR))), 1, 15))::BIGINT AS shuffle_key
FROM p, k"""


@query("conn_training_chain", section="2.7", sql=_conn_training_sql())
def q_conn_training_chain(spark, sf_dir):
    """The whole chain: feature selection, trainability check and seeded
    shuffle. Dropped features come back as null columns, so that the schema
    does not depend on the data."""
    out = CP.prepare_for_training(_conn(spark, sf_dir), key_name="shuffle_key")
    names = [c for c in CONN_FEATURES if c not in out.columns]
    return rounded(out.select("*", *[F.lit(None).cast("double").alias(c) for c in names]))


def _public(x):
    from kiln.functions.net import _dotted_to_int
    return " AND ".join([f"{x} IS NOT NULL"] + [f"NOT ({x} BETWEEN {_dotted_to_int(a)} AND {_dotted_to_int(b)})"
                                                 for a, b in RESERVED_IPV4_BLOCKS])


@query("conn_prep_legacy", section="2.7", sql=f"""
WITH {CONN_CTE},
p AS (SELECT *, CAST(split_part("id.resp_h", '.', 1) AS BIGINT) * 16777216 + CAST(split_part("id.resp_h", '.', 2) AS BIGINT) * 65536
              + CAST(split_part("id.resp_h", '.', 3) AS BIGINT) * 256 + CAST(split_part("id.resp_h", '.', 4) AS BIGINT) AS ipn
      FROM conn),
rng AS (SELECT CAST(n_nationkey * 10 AS BIGINT) * 16777216 AS start_ip,
               CAST(n_nationkey * 10 AS BIGINT) * 16777216 + 10 * 16777216 - 1 AS end_ip,
               n_name AS resp_country, CAST(n_nationkey + 64512 AS BIGINT) AS resp_asn FROM nation)
SELECT ts, duration, orig_bytes, resp_bytes, "id.orig_p", "id.resp_p", tunnel_parents IS NOT NULL AS is_tunneled,
       rng.resp_country, rng.resp_asn,
       CAST(coalesce(proto = 'icmp', false) AS TINYINT) AS proto_icmp,
       CAST(coalesce(proto = 'tcp', false) AS TINYINT) AS proto_tcp,
       CAST(coalesce(proto = 'udp', false) AS TINYINT) AS proto_udp,
       coalesce(label IN ('Malicious   C&C'), false) AS is_cc
FROM p LEFT JOIN rng ON {_public('p.ipn')} AND p.ipn BETWEEN rng.start_ip AND rng.end_ip
""")
def q_conn_prep_legacy(spark, sf_dir):
    from kiln.operators.joins import ip_range_join
    t = tables(spark, sf_dir)
    c = S.conn_log(t)
    c = c.withColumn("is_cc", O.label_in("label", ["Malicious   C&C"])) \
         .withColumn("is_tunneled", F.col("tunnel_parents").isNotNull())
    rng = S.ip_ranges(t).withColumnRenamed("country", "resp_country").withColumnRenamed("asn", "resp_asn")
    c = ip_range_join(c, rng, "id.resp_h")
    c = c.select("ts", "duration", "orig_bytes", "resp_bytes", "`id.orig_p`", "`id.resp_p`", "is_tunneled",
                 "resp_country", "resp_asn", "proto", "is_cc")
    c = P.one_hot(c, "proto")
    return O.reorder_label_last(c, "is_cc")
