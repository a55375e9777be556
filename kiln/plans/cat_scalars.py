"""Catalog: scalar rules (2.6), network inventory, connection features and
the planned-only data operators (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import hashing as FH
from kiln.functions import net as FN
from kiln.functions import strings as FS
from kiln.functions import timefn as FT
from kiln.operators import events as EV
from kiln.operators import joins as J
from kiln.operators import relational as O
from kiln.operators import structured as ST
from kiln.plans import network as NW
from kiln.plans import standins as S
from kiln.plans._q import rounded, tables
from kiln.plans.oracle import CONN_CTE, NET_CTES
from kiln.registry import query
from kiln.sources.sinks import snapshot

MAC_RE = r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"


def _conn(spark, sf_dir):
    return S.conn_log(tables(spark, sf_dir))


@query("label_from_class", section="2.2", sql=f"""
WITH {CONN_CTE}
SELECT uid, label, NOT coalesce(label IN ('Benign'), false) AS is_malware,
       coalesce(label IN ('Malicious   C&C'), false) AS is_cc FROM conn
""")
def q_label_from_class(spark, sf_dir):
    c = _conn(spark, sf_dir)
    return c.select("uid", "label", O.label_not_in("label", ["Benign"]).alias("is_malware"),
                    O.label_in("label", ["Malicious   C&C"]).alias("is_cc"))


HOUR_SQL = "(floor(ts / 3600) % 24 + (floor(ts / 60) % 60) / 60.0)"


@query("epoch_to_hour", section="2.6", sql=f"""
WITH {CONN_CTE} SELECT uid, round({HOUR_SQL}, 6) AS hour_of_day FROM conn
""")
def q_epoch_to_hour(spark, sf_dir):
    return rounded(_conn(spark, sf_dir).select("uid", FT.epoch_to_hour("ts").alias("hour_of_day")))


@query("shift_hour", section="2.6", sql=f"""
WITH {CONN_CTE} SELECT uid, round(((({HOUR_SQL}) - 18) % 24 + 24) % 24, 6) AS hour_shifted FROM conn
""")
def q_shift_hour(spark, sf_dir):
    c = _conn(spark, sf_dir)
    return rounded(c.select("uid", FT.shift_hour(FT.epoch_to_hour("ts"), -18).alias("hour_shifted")))


@query("port_range", section="2.6", sql=f"""
WITH {CONN_CTE}
SELECT uid, "id.resp_p" AS port,
       CASE WHEN "id.resp_p" BETWEEN 1 AND 1023 THEN 0 WHEN "id.resp_p" BETWEEN 1024 AND 49151 THEN 1
            WHEN "id.resp_p" BETWEEN 49152 AND 65535 THEN 2 ELSE 3 END AS port_range FROM conn
""")
def q_port_range(spark, sf_dir):
    c = _conn(spark, sf_dir)
    return c.select("uid", F.col("`id.resp_p`").alias("port"), FN.port_range("`id.resp_p`").alias("port_range"))


@query("is_tunneled", section="2.6", sql=f"""
WITH {CONN_CTE} SELECT uid, tunnel_parents IS NOT NULL AS is_tunneled FROM conn
""")
def q_is_tunneled(spark, sf_dir):
    return _conn(spark, sf_dir).select("uid", F.col("tunnel_parents").isNotNull().alias("is_tunneled"))


@query("byte_ratio", section="2.10", sql=f"""
WITH {CONN_CTE}
SELECT uid, round(CASE WHEN orig_bytes <> 0 THEN resp_bytes / orig_bytes END, 6) AS byte_ratio,
       round(CASE WHEN orig_pkts <> 0 THEN resp_pkts / orig_pkts END, 6) AS pkt_ratio FROM conn
""")
def q_byte_ratio(spark, sf_dir):
    c = _conn(spark, sf_dir)
    return rounded(c.select("uid", EV.ratio(F.col("resp_bytes"), F.col("orig_bytes")).alias("byte_ratio"),
                            EV.ratio(F.col("resp_pkts"), F.col("orig_pkts")).alias("pkt_ratio")))


@query("service_port_mismatch", section="2.10", sql=f"""
WITH {CONN_CTE},
m(svc, exp_proto, exp_port) AS (VALUES ('http', 'tcp', 80), ('ssl', 'tcp', 443), ('dns', 'udp', 53), ('ssh', 'tcp', 22))
SELECT uid, service, proto, "id.resp_p" AS port,
       CASE WHEN m.svc IS NULL THEN NULL ELSE proto <> exp_proto OR "id.resp_p" <> exp_port END AS mismatch
FROM conn LEFT JOIN m ON conn.service = m.svc
""")
def q_service_port_mismatch(spark, sf_dir):
    c = _conn(spark, sf_dir).select("uid", "service", "proto", F.col("`id.resp_p`").alias("port"))
    return EV.service_port_mismatch(c, "service", "proto", "port").select("uid", "service", "proto", "port",
                                                                          "mismatch")


@query("first_contact", section="2.10", sql=f"""
WITH {CONN_CTE}
SELECT "id.orig_h", "id.resp_p", ts, uid, orig_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY "id.orig_h", "id.resp_p" ORDER BY ts, uid) AS rn FROM conn) WHERE rn = 1
""")
def q_first_contact(spark, sf_dir):
    c = _conn(spark, sf_dir).select("`id.orig_h`", "`id.resp_p`", "ts", "uid", "orig_bytes")
    return EV.first_contact(c, ["id.orig_h", "id.resp_p"], "ts", "uid")


@query("bandwidth_24h", section="2.10", sql=f"""
WITH {CONN_CTE}
SELECT uid, sum(orig_bytes + resp_bytes) OVER (PARTITION BY "id.orig_h", "id.resp_p" ORDER BY ts
       RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS bytes_24h FROM conn
""")
def q_bandwidth_24h(spark, sf_dir):
    c = _conn(spark, sf_dir)
    out = EV.trailing_sum(c, ["id.orig_h", "id.resp_p"], "ts", F.col("orig_bytes") + F.col("resp_bytes"),
                          86400.0, "bytes_24h")
    return out.select("uid", "bytes_24h")


@query("json_to_columns", section="2.6", sql="""
SELECT event_id, coalesce(CAST(json_extract(props, '$.quarter_created') AS INTEGER), 0) AS quarter_created,
       coalesce(CAST(json_extract(props, '$.quarter_closed') AS INTEGER), 0) AS quarter_closed,
       json_extract_string(props, '$.primary_product') AS primary_product,
       CAST(json_extract(props, '$.partner_involved') AS BOOLEAN) AS partner_involved,
       json_extract_string(props, '$.k') AS k
FROM events
""")
def q_json_to_columns(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "props")
    schema = T.StructType([T.StructField("quarter_created", T.IntegerType()),
                           T.StructField("quarter_closed", T.IntegerType()),
                           T.StructField("primary_product", T.StringType()),
                           T.StructField("partner_involved", T.BooleanType())])
    return ST.json_to_columns(e, "props", schema, {"quarter_created": 0, "quarter_closed": 0})


PRODUCT_SQL = """
pp AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN ''
                              WHEN p_size = 3 THEN p_type || '|' || p_name
                              ELSE p_type || '|' || split_part(p_name, ' ', 1) || '|'
                                   || CASE WHEN p_size % 2 = 0 THEN 'cloud' ELSE '' END END AS primary_product
       FROM part)"""


@query("split_composite", section="2.6", sql=f"""
WITH {PRODUCT_SQL}
SELECT p_partkey, nullif(split_part(primary_product, '|', 1), '') AS product_category,
       nullif(split_part(primary_product, '|', 2), '') AS product_family,
       nullif(split_part(primary_product, '|', 3), '') AS product_hosting FROM pp
""")
def q_split_composite(spark, sf_dir):
    p = tables(spark, sf_dir).part
    prod = (F.when(F.col("p_size") == 1, F.lit(None).cast("string")).when(F.col("p_size") == 2, F.lit(""))
            .when(F.col("p_size") == 3, F.concat(F.col("p_type"), F.lit("|"), F.col("p_name")))
            .otherwise(F.concat(F.col("p_type"), F.lit("|"), F.substring_index(F.col("p_name"), " ", 1), F.lit("|"),
                                F.when(F.col("p_size") % 2 == 0, F.lit("cloud")).otherwise(F.lit("")))))
    pp = p.select("p_partkey", prod.alias("primary_product"))
    return ST.split_composite(pp, "primary_product", ["product_category", "product_family", "product_hosting"])


@query("first_token", section="2.6", sql="""
SELECT conv_id, turn, nullif(regexp_extract(text, '([^\\s]+)', 1), '') AS first_token FROM conversations
""")
def q_first_token(spark, sf_dir):
    c = tables(spark, sf_dir).conversations
    return c.select("conv_id", "turn", FS.first_token("text").alias("first_token"))


@query("contains_flag", section="2.6", sql="""
SELECT p_partkey, contains(p_name, 'ring') AS managed_service FROM part
""")
def q_contains_flag(spark, sf_dir):
    p = tables(spark, sf_dir).part
    return p.select("p_partkey", FS.contains_flag("p_name", "ring").alias("managed_service"))


@query("extract_links", section="2.6", sql="""
SELECT DISTINCT page_id, link FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
WHERE contains(link, '/') ORDER BY page_id, link DESC
""")
def q_extract_links(spark, sf_dir):
    pg = tables(spark, sf_dir).pages
    links = pg.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("link"))
    return links.where(F.col("link").contains("/")).distinct().orderBy("page_id", F.desc("link"))


@query("sha256_rows", section="2.6", sql="SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_sha256_rows(spark, sf_dir):
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


@query("table_fingerprint", section="2.6", sql="""
WITH h AS (SELECT ('0x' || substr(md5(concat_ws(chr(31),
         coalesce(CAST(o_orderkey AS VARCHAR), '\\N'), coalesce(CAST(o_custkey AS VARCHAR), '\\N'),
         coalesce(o_orderstatus, '\\N'), coalesce(o_orderpriority, '\\N'))), 1, 15))::BIGINT AS v FROM orders)
SELECT count(*) AS n_rows, bit_xor(v) AS xor_hash, CAST(sum(v::HUGEINT) AS VARCHAR) AS sum_hash FROM h
""")
def q_table_fingerprint(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return FH.table_fingerprint_md5(o)


@query("format_eastern_ts", section="2.6", sql="""
SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S.%f')
       AS ts_eastern FROM events
""")
def q_format_eastern_ts(spark, sf_dir):
    e = tables(spark, sf_dir).events
    return e.select("event_id", FT.format_in_zone("ts", "America/New_York").alias("ts_eastern"))


# --------------------------------------------------------------- network


@query("mac_normalise", section="2.6", sql=f"""
WITH {NET_CTES}
SELECT host_id, mac, CASE WHEN regexp_matches(mac, '{MAC_RE}') THEN lower(replace(mac, '-', ':')) END AS mac_norm,
       NOT regexp_matches(mac, '{MAC_RE}') AS mac_error FROM expected
""")
def q_mac_normalise(spark, sf_dir):
    e = S.expected_hosts(tables(spark, sf_dir))
    return e.select("host_id", "mac", FN.mac_normalise("mac").alias("mac_norm"),
                    (~FN.mac_is_valid("mac")).alias("mac_error"))


@query("short_hostname", section="2.6", sql=f"""
WITH {NET_CTES}
SELECT ip, host, lower(split_part(regexp_replace(host, '\\.$', ''), '.', 1)) AS short_host FROM dns_ptr
""")
def q_short_hostname(spark, sf_dir):
    p = S.dns_ptr(tables(spark, sf_dir))
    return p.select("ip", "host", FN.short_hostname("host").alias("short_host"))


@query("equals_ignore_case_flag", section="2.6", sql=f"""
WITH {NET_CTES}
SELECT e.host_id, CASE WHEN lower(e.fqdn) = lower(a.fqdn) THEN 'Y' ELSE 'N' END AS same_name
FROM expected e JOIN dns_a a ON e.ip = a.ip
""")
def q_equals_ignore_case_flag(spark, sf_dir):
    t = tables(spark, sf_dir)
    e, a = S.expected_hosts(t), S.dns_a(t)
    j = e.join(a, e.ip == a.ip)
    return j.select(e.host_id, FN.equals_ignore_case_flag(e.fqdn, a.fqdn).alias("same_name"))


@query("filter_ip_pattern", section="2.6", sql=f"""
WITH {NET_CTES}
SELECT host_id, ip FROM expected WHERE regexp_matches(ip, '10\\.0\\.1\\.[1-2][0-9][0-9]')
""")
def q_filter_ip_pattern(spark, sf_dir):
    e = S.expected_hosts(tables(spark, sf_dir)).select("host_id", "ip")
    return O.filter_regex(e, "ip", r"10\.0\.1\.[1-2][0-9][0-9]")


@query("anti_join_missing", section="2.3", sql=f"""
WITH {NET_CTES}, en AS (
  SELECT *, CASE WHEN regexp_matches(mac, '{MAC_RE}') THEN lower(replace(mac, '-', ':')) END AS mac_norm FROM expected)
SELECT host_id, mac, ip, fqdn FROM en
WHERE NOT EXISTS (SELECT 1 FROM arp WHERE lower(trim(arp.mac)) = lower(trim(en.mac_norm)))
""")
def q_anti_join_missing(spark, sf_dir):
    return NW.hosts_not_live(tables(spark, sf_dir))


NET_REPORT_SQL = f"""
WITH {NET_CTES},
e AS (SELECT host_id, CASE WHEN regexp_matches(mac, '{MAC_RE}') THEN lower(replace(mac, '-', ':')) END AS mac_norm,
             NOT regexp_matches(mac, '{MAC_RE}') AS mac_error, ip, fqdn,
             lower(split_part(regexp_replace(fqdn, '\\.$', ''), '.', 1)) AS short_host FROM expected),
a AS (SELECT lower(replace(mac, '-', ':')) AS arp_mac, min(ip) AS arp_ip FROM arp
      WHERE regexp_matches(mac, '{MAC_RE}') GROUP BY 1),
f AS (SELECT lower(fqdn) AS fwd_fqdn, min(ip) AS fwd_ip FROM dns_a GROUP BY 1),
r AS (SELECT ip AS rev_ip, min(lower(regexp_replace(host, '\\.$', ''))) AS rev_host FROM dns_ptr GROUP BY 1)
SELECT host_id, mac_norm, mac_error, ip, short_host,
       CASE WHEN arp_mac IS NOT NULL THEN 'Y' ELSE 'N' END AS live,
       CASE WHEN arp_mac IS NULL THEN 'not live' WHEN arp_ip = ip THEN 'Y' ELSE 'N' END AS ip_match,
       CASE WHEN fwd_ip IS NULL THEN 'NR' WHEN lower(fwd_ip) = lower(ip) THEN 'Y' ELSE 'N' END AS fwd_dns,
       CASE WHEN rev_host IS NULL THEN 'NR' WHEN lower(rev_host) = lower(fqdn) THEN 'Y' ELSE 'N' END AS rev_dns
FROM e LEFT JOIN a ON e.mac_norm = a.arp_mac LEFT JOIN f ON lower(e.fqdn) = f.fwd_fqdn
     LEFT JOIN r ON e.ip = r.rev_ip
"""


@query("network_inventory_report", section="2.7", sql=NET_REPORT_SQL)
def q_network_inventory_report(spark, sf_dir):
    return NW.network_inventory_report(tables(spark, sf_dir))


@query("compare_expected_observed", section="2.3", sql=f"""
{NET_REPORT_SQL.replace('SELECT host_id, mac_norm, mac_error, ip, short_host,', 'SELECT host_id,', 1)}
""")
def q_compare_expected_observed(spark, sf_dir):
    return NW.network_inventory_report(tables(spark, sf_dir)).select("host_id", "live", "ip_match", "fwd_dns",
                                                                     "rev_dns")


def _ipn_sql(x):
    o = [f"CAST(regexp_extract({x}, '^([0-9]{{1,3}})\\.([0-9]{{1,3}})\\.([0-9]{{1,3}})\\.([0-9]{{1,3}})$', {i}) AS BIGINT)"
         for i in range(1, 5)]
    ok = " AND ".join(f"{v} <= 255" for v in o)
    return (f"CASE WHEN regexp_matches({x}, '^([0-9]{{1,3}})\\.([0-9]{{1,3}})\\.([0-9]{{1,3}})\\.([0-9]{{1,3}})$') "
            f"AND {ok} THEN {o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]} END")


def _public_sql(x):
    parts = [f"{x} IS NOT NULL"]
    for lo, hi in FN.RESERVED_IPV4_BLOCKS:
        parts.append(f"NOT ({x} BETWEEN {FN._dotted_to_int(lo)} AND {FN._dotted_to_int(hi)})")
    return " AND ".join(parts)


@query("ip_range_join", section="2.3", sql=f"""
WITH pts AS (SELECT doc_id, ip, {_ipn_sql('ip')} AS ipn FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})', 1)) AS ip FROM documents)),
rng AS (SELECT CAST(n_nationkey * 10 AS BIGINT) * 16777216 AS start_ip,
               CAST(n_nationkey * 10 AS BIGINT) * 16777216 + 10 * 16777216 - 1 AS end_ip,
               n_name AS country, CAST(n_nationkey + 64512 AS BIGINT) AS asn FROM nation)
SELECT pts.doc_id, pts.ip, rng.country, rng.asn FROM pts
LEFT JOIN rng ON {_public_sql('pts.ipn')} AND pts.ipn BETWEEN rng.start_ip AND rng.end_ip
""")
def q_ip_range_join(spark, sf_dir):
    t = tables(spark, sf_dir)
    # the join reads its points twice; the addresses are taken out of the texts once
    return J.ip_range_join(snapshot(S.document_ips(t), "document-ips"), S.ip_ranges(t), "ip")


@query("incremental_manifest", section="2.3", sql="""
SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents
""")
def q_incremental_manifest(spark, sf_dir):
    d = tables(spark, sf_dir).documents.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"),
        "lang")
    # the manifest already holds the English documents; only the rest are hashed now
    manifest = d.where(F.col("lang") == "en").select("path", F.sha2(F.col("content"), 256).alias("sha256"))
    return J.incremental_manifest(d, manifest)


@query("snapshot_diff", section="2.10", sql="""
WITH old AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
new AS (SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 1.1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey,
       CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN new.o_orderkey IS NULL THEN 'removed'
            WHEN old.o_totalprice IS DISTINCT FROM new.o_totalprice OR old.o_custkey IS DISTINCT FROM new.o_custkey
              OR old.o_orderstatus IS DISTINCT FROM new.o_orderstatus OR old.o_orderdate IS DISTINCT FROM new.o_orderdate
              OR old.o_orderpriority IS DISTINCT FROM new.o_orderpriority THEN 'changed' ELSE 'unchanged' END AS status
FROM old FULL OUTER JOIN new ON old.o_orderkey = new.o_orderkey
""")
def q_snapshot_diff(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    old = o.where(F.col("o_orderstatus").isin("F", "O"))
    new = o.where(F.col("o_orderstatus").isin("O", "P")).withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 1.1)
        .otherwise(F.col("o_totalprice")))
    return J.snapshot_diff(old, new, "o_orderkey")
