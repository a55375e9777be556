"""DuckDB SQL fragments used by the oracle statements.

These are written independently of the Spark code: they restate each
stand-in table and scalar rule in plain SQL so that a registered query and
its oracle only agree when both are right.
"""

from __future__ import annotations


def html_to_text_sql(x: str) -> str:
    s = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, "
         r"'(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), "
         r"'(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")]:
        s = f"replace({s}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({s}, '[ \\t\\n\\r]+', ' ', 'g'))"


RISK_CTES = """
dim_vulnerability AS (
  SELECT p_partkey AS vulnerability_id, p_size / 5.3::DOUBLE AS cvss_score,
         CASE WHEN p_size >= 40 THEN 'Critical' WHEN p_size >= 25 THEN 'Severe' ELSE 'Moderate' END AS severity,
         p_name AS title, '<p>' || p_name || ' &amp; ' || p_type || '</p>' AS description,
         p_size % 4 AS exploits,
         CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'L' WHEN p_type = 'PROMO' THEN 'A' ELSE 'N' END
           AS cvss_access_vector_id
  FROM part),
dim_vulnerability_reference AS (
  SELECT DISTINCT l_partkey AS vulnerability_id,
         CASE WHEN l_returnflag = 'R' THEN 'CVE' ELSE 'BID' END AS source,
         CASE WHEN l_returnflag = 'R' THEN 'CVE' ELSE 'BID' END || '-' || CAST(l_suppkey AS VARCHAR) AS reference
  FROM lineitem),
dim_asset AS (
  SELECT c_custkey AS asset_id, c_name AS host_name,
         '10.' || CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % 250 AS VARCHAR) || '.1' AS ip_address
  FROM customer),
dim_asset_host_name AS (
  SELECT c_custkey AS asset_id, lower(replace(c_name, '#', '-')) AS host_name,
         CASE WHEN c_acctbal >= 0 THEN 'N' ELSE 'D' END AS source_type_id
  FROM customer),
dim_tag AS (
  SELECT n_nationkey AS tag_id, 'HV' || CAST(n_nationkey % 12 AS VARCHAR) AS tag_name FROM nation
  UNION ALL SELECT r_regionkey + 100, r_name FROM region),
dim_tag_asset AS (
  SELECT c_nationkey AS tag_id, c_custkey AS asset_id FROM customer WHERE c_acctbal >= -500
  UNION ALL
  SELECT n_regionkey + 100, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
dim_asset_vulnerability_best_solution AS (
  SELECT asset_id, vulnerability_id, CAST(vulnerability_id % 5 AS INTEGER) AS solution_id FROM (
    SELECT DISTINCT o_custkey AS asset_id, l_partkey AS vulnerability_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
dim_solution AS (
  SELECT r_regionkey AS solution_id, '<li>Apply vendor patch for ' || r_name || '</li>' AS fix FROM region),
dim_cvss_access_vector AS (
  SELECT CASE r_regionkey WHEN 0 THEN 'L' WHEN 1 THEN 'A' ELSE 'N' END AS type_id,
         CASE r_regionkey WHEN 0 THEN 'Local' WHEN 1 THEN 'Adjacent Network' ELSE 'Network' END AS description
  FROM region WHERE r_regionkey < 3),
dim_protocol AS (
  SELECT r_regionkey AS protocol_id,
         CASE r_regionkey WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' WHEN 3 THEN 'TCP' ELSE 'UDP' END AS name
  FROM region),
dim_service AS (SELECT n_nationkey AS service_id FROM nation),
fact_asset_vulnerability_instance AS (
  SELECT o_custkey AS asset_id, l_partkey AS vulnerability_id, l_linenumber % 5 AS protocol_id,
         CAST(l_suppkey % 25 AS INTEGER) AS service_id,
         CASE WHEN l_linestatus = 'O' THEN -1 ELSE l_linenumber + 1000 END AS port,
         '<b>qty</b> ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' &gt; ' || l_returnflag AS proof
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


# What the report's building blocks come to over the driver tables, stated
# without the stand-in tables or their joins: one list per part, one per customer.
VULN_REFERENCES_SQL = """
listed AS (
  SELECT l_partkey, array_to_string(list_sort(list(DISTINCT 'CVE-' || l_suppkey) FILTER (l_returnflag = 'R')), ', ') AS cves,
         array_to_string(list_sort(list(DISTINCT 'BID-' || l_suppkey) FILTER (l_returnflag <> 'R')), ', ') AS others
  FROM lineitem GROUP BY ALL),
vuln_references AS (
  SELECT p_partkey AS vulnerability_id, round((p_size / 5.3::DOUBLE)::DECIMAL(38,10), 1)::DOUBLE AS vuln_cvss,
         ['Moderate', 'Severe', 'Critical'][1 + (p_size >= 25)::INT + (p_size >= 40)::INT] AS vuln_severity, p_name AS vuln_name,
         printf('<p>%s &amp; %s</p>', p_name, p_type) AS description, p_size % 4 AS exploitability,
         coalesce(map {'ECONOMY': 'L', 'SMALL': 'L', 'PROMO': 'A'}[p_type], 'N') AS cvss_access_vector_id,
         cves, others AS other_references
  FROM part, listed WHERE p_partkey = l_partkey)"""


ASSET_TAGS_SQL = """
tagged AS (
  SELECT c_custkey, list_sort(list_filter([CASE WHEN c_acctbal >= -500 THEN 'HV' || c_nationkey % 12 END,
                              CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN r_name END], lambda t: t IS NOT NULL)) AS tags
  FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey),
asset_tags AS (
  SELECT c_custkey AS asset_id, c_name AS host_name, printf('10.%d.%d.1', c_nationkey, c_custkey % 250) AS ip_address,
         CASE WHEN c_acctbal >= 0 THEN lower(replace(c_name, '#', '-')) END AS netbios_name,
         array_to_string(tags, ', ') AS asset_tags
  FROM customer JOIN tagged USING (c_custkey))"""


PROC_CTES = """
part_keys AS (
  SELECT p.*, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)
           || CASE WHEN p_type IN ('SMALL', 'PROMO') THEN '.dll' ELSE '.exe' END AS filename,
         CASE WHEN p_size = 1 THEN NULL ELSE p_brand END AS pathroot
  FROM part p),
digest_image AS (
  SELECT pk.filename, pk.pathroot, pk.p_type AS probablecompanyname, l_suppkey AS clientguid,
         CASE WHEN l_returnflag = 'R' THEN 'acme' ELSE 'globex' END AS customer
  FROM lineitem JOIN part_keys pk ON l_partkey = pk.p_partkey),
digest_system AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'acme' ELSE 'globex' END AS customer, l_suppkey AS clientguid,
         l_shipdate AS "timestamp" FROM lineitem),
label_process AS (
  SELECT p_partkey AS id, filename, pathroot, CASE WHEN p_retailprice < 950 THEN 'NL' ELSE 'GOOD' END AS demeanor,
         p_name AS description, p_brand AS vendorname, p_size AS prevelance FROM part_keys
  UNION ALL
  SELECT p_partkey + 1000000000, filename, pathroot, 'BAD', p_name, p_brand, p_size FROM part_keys WHERE p_size >= 48),
digest_scoring AS (
  SELECT pk.filename, pk.pathroot,
         CASE WHEN l_linestatus = 'O' THEN 'run;AUTOSTART;svc' WHEN l_returnflag = 'A' THEN 'manual'
              ELSE 'Autostart-delayed' END AS extraneousattributes,
         l_shipdate AS "timestamp"
  FROM lineitem JOIN part_keys pk ON l_partkey = pk.p_partkey)
"""

# A process is a part: its file name holds the part's key, and a label without
# a path root (p_size 1) matches nothing. Every part has one label of its own,
# those of size 48 and more a second one.
PREV_SQL = """
tmp_cust_proc_prev AS (
  SELECT filename, pathroot, p_type AS probablecompanyname, clients AS customer_prevalence, unnest(labels).word AS demeanor,
         unnest(labels).id AS label_id, p_size AS global_prevalence
  FROM (SELECT *, list_filter([{'id': p_partkey, 'word': CASE WHEN p_retailprice < 950 THEN 'NL' ELSE 'GOOD' END},
                               {'id': p_partkey + 1000000000, 'word': CASE WHEN p_size >= 48 THEN 'BAD' END}], lambda l: l.word IS NOT NULL) AS labels
        FROM part_keys WHERE p_size <> 1 AND filename LIKE '%.exe')
  JOIN (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS clients FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) USING (p_partkey))"""

# The second table repeats a row for each of the two ways an autostart is
# written: with an open line, and with any other line that is not flagged A.
PREV2_SQL = """
tmp_cust_proc_prev2 AS (
  SELECT seen.* FROM tmp_cust_proc_prev seen
  JOIN (SELECT DISTINCT l_partkey, l_linestatus = 'O' AS spelling FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag <> 'A') starts
    ON label_id % 1000000000 = l_partkey
  WHERE customer_prevalence > 9)"""

EMAIL_CTES = """
emails AS (
  SELECT c_custkey AS email_id,
         CASE WHEN c_acctbal < -900 THEN NULL
              WHEN c_mktsegment = 'AUTOMOBILE' THEN loc || ' at ' || dom
              WHEN c_mktsegment = 'BUILDING' THEN '  ' || upper(loc) || '@' || upper(dom) || ' '
              WHEN c_mktsegment = 'FURNITURE' THEN loc || '@' || loc || '@' || dom
              WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0 THEN loc || '@bcde'
              ELSE loc || '@' || dom END AS email
  FROM (SELECT *, lower(replace(c_name, 'Customer#', 'cust')) AS loc,
               'mail' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_nationkey % 5 = 3 THEN '.co.uk' ELSE '.com' END AS dom
        FROM customer)
  UNION ALL
  SELECT -doc_id - 1, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1)) FROM documents)
"""


CONN_CTE = """
conn AS (
  SELECT epoch_us(CAST(ts AS TIMESTAMP)) / 1000000.0 AS ts, 'C' || CAST(event_id AS VARCHAR) AS uid,
         '192.168.1.' || CAST(user_id % 250 + 1 AS VARCHAR) AS "id.orig_h",
         CAST(((event_id * 7919) % 65536 + 65536) % 65536 AS INTEGER) AS "id.orig_p",
         concat_ws('.', CAST((event_id * 37) % 256 AS VARCHAR), CAST((event_id * 91) % 256 AS VARCHAR),
                   CAST((user_id * 13) % 256 AS VARCHAR), CAST(event_id % 256 AS VARCHAR)) AS "id.resp_h",
         CAST(CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8443 WHEN 'signup' THEN 0
              ELSE ((user_id * 31) % 65536 + 65536) % 65536 END AS INTEGER) AS "id.resp_p",
         CASE WHEN event_type IN ('view', 'click') THEN 'tcp' WHEN event_type = 'error' THEN 'icmp' ELSE 'udp' END AS proto,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'http' WHEN event_type = 'click' THEN 'ssl' END AS service,
         CASE WHEN event_type <> 'error' THEN value / 10.0 END AS duration,
         CAST(trunc(value * 100) AS BIGINT) AS orig_bytes, CAST(trunc(value * 37) AS BIGINT) AS resp_bytes,
         CAST(trunc(value * 100) AS BIGINT) % 7 * 5000 AS missed_bytes,
         user_id % 20 + 1 AS orig_pkts,
         CAST(trunc(value * 100) AS BIGINT) + 40 * (user_id % 20 + 1) AS orig_ip_bytes,
         event_id % 150 AS resp_pkts,
         CAST(trunc(value * 37) AS BIGINT) + 40 * (event_id % 150) AS resp_ip_bytes,
         CASE WHEN user_id % 50 = 0 THEN 'T' || CAST(user_id AS VARCHAR) END AS tunnel_parents,
         CASE WHEN user_id = 0 THEN NULL WHEN event_type = 'error' THEN 'Malicious   C&C'
              WHEN event_type = 'signup' THEN 'Malicious   DDoS' ELSE 'Benign' END AS label
  FROM events)"""

NET_CTES = """
hx AS (SELECT s.*, lpad(hex((s_suppkey * 2654435761) % 281474976710656), 12, '0') AS h FROM supplier s),
expected AS (
  SELECT s_suppkey AS host_id,
         CASE WHEN s_acctbal < 0 THEN 'zz' || substr(h, 3, 10)
              WHEN s_nationkey % 4 = 0 THEN upper(concat_ws('-', substr(h, 1, 2), substr(h, 3, 2), substr(h, 5, 2),
                                                             substr(h, 7, 2), substr(h, 9, 2), substr(h, 11, 2)))
              ELSE lower(concat_ws(':', substr(h, 1, 2), substr(h, 3, 2), substr(h, 5, 2), substr(h, 7, 2),
                                   substr(h, 9, 2), substr(h, 11, 2))) END AS mac,
         CAST((s_suppkey // 16777216) % 100 + 10 AS VARCHAR) || '.' || CAST((s_suppkey // 65536) % 256 AS VARCHAR) || '.' ||
           CAST((s_suppkey // 256) % 256 AS VARCHAR) || '.' || CAST(s_suppkey % 256 AS VARCHAR) AS ip,
         lower(replace(s_name, '#', '')) || '.corp.example.com' AS fqdn,
         s_acctbal, s_nationkey
  FROM hx),
arp AS (
  SELECT lower(replace(mac, '-', ':')) AS mac,
         CASE WHEN s_nationkey = 7 THEN '10.9.9.' || CAST(host_id % 250 AS VARCHAR) ELSE ip END AS ip,
         split_part(fqdn, '.', 1) AS host
  FROM expected WHERE s_acctbal > 0),
dns_a AS (
  SELECT CASE WHEN s_nationkey = 2 THEN upper(fqdn) ELSE fqdn END AS fqdn,
         CASE WHEN s_nationkey = 9 THEN '10.8.8.8' ELSE ip END AS ip
  FROM expected WHERE s_nationkey <> 5),
dns_ptr AS (
  SELECT ip, CASE WHEN host_id % 2 = 0 THEN fqdn || '.' ELSE fqdn END AS host FROM expected WHERE s_nationkey <> 6)
"""
