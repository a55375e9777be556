"""Catalog: the vulnerability risk report and its building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.strings import html_to_text, round_numeric, sentinel_to_null, tag_score
from kiln.plans import risk_report as R
from kiln.plans import standins as S
from kiln.plans._q import rounded, tables
from kiln.plans.oracle import ASSET_TAGS_SQL, RISK_CTES, VULN_REFERENCES_SQL, html_to_text_sql
from kiln.registry import query

H = html_to_text_sql
TAG_CASE_SQL = """CASE WHEN {x} LIKE '%HV0%' THEN 5 WHEN {x} LIKE '%HV1%' THEN 4 WHEN {x} LIKE '%HV2%' THEN 3
  WHEN {x} LIKE '%HV3%' THEN 2 WHEN {x} LIKE '%HV4%' THEN 1 ELSE 0 END"""


@query("risk_score_report", section="2.7", sql=f"""
WITH {VULN_REFERENCES_SQL}, {ASSET_TAGS_SQL},
vectors AS (SELECT * FROM (VALUES ('L', 'Local'), ('A', 'Adjacent Network'), ('N', 'Network')) v(type_id, description)),
found AS (
  SELECT o_custkey AS asset_id, l_partkey AS vulnerability_id,
         ['TCP', 'UDP', 'ICMP', 'TCP', 'UDP'][1 + l_linenumber % 5] AS protocol,
         CASE WHEN l_linestatus <> 'O' THEN l_linenumber + 1000 END AS ports,
         printf('<b>qty</b> %d &gt; %s', l_quantity::BIGINT, l_returnflag) AS proof,
         (SELECT '<li>Apply vendor patch for ' || r_name || '</li>' FROM region WHERE r_regionkey = l_partkey % 5) AS patch
  FROM orders, lineitem WHERE o_orderkey = l_orderkey)
SELECT vulnerability_id AS pluginid, cves, vuln_cvss, type_id, vectors.description, asset_tags,
       round(vuln_cvss + {TAG_CASE_SQL.format(x='asset_tags')}, 6) AS prospect_custom_risk, vuln_severity, host_name AS host,
       ip_address, netbios_name, asset_id, protocol, ports, vuln_name, {H('vuln_references.description')} AS vuln_synopsis,
       {H('vuln_references.description')} AS vuln_description, {H('patch')} AS solution,
       other_references AS see_also_additional_resources, {H('proof')} AS plugin_output_proof, exploitability,
       -1 AS assigned_asset_category, -1 AS calculated_priority, -1 AS remediation_assignee, -1 AS fields_for_query
FROM found JOIN vuln_references USING (vulnerability_id) JOIN asset_tags USING (asset_id)
LEFT JOIN vectors ON type_id = cvss_access_vector_id
""")
def q_risk_score_report(spark, sf_dir):
    return rounded(R.risk_score_report(tables(spark, sf_dir)))


@query("string_agg_filtered", section="2.4", sql=f"""
WITH {VULN_REFERENCES_SQL} SELECT * FROM vuln_references
""")
def q_string_agg_filtered(spark, sf_dir):
    return R.vuln_references(tables(spark, sf_dir), keep_orphans=True)


@query("join_left_chain", section="2.3", sql=f"""
WITH {ASSET_TAGS_SQL} SELECT * FROM asset_tags
""")
def q_join_left_chain(spark, sf_dir):
    return R.asset_tags(tables(spark, sf_dir))


@query("join_fanout_lookup", section="2.3", sql=f"""
WITH {VULN_REFERENCES_SQL.replace(', listed WHERE p_partkey = l_partkey', ' LEFT JOIN listed ON p_partkey = l_partkey')}
SELECT type_id, v.description, vulnerability_id
FROM (VALUES ('L', 'Local'), ('A', 'Adjacent Network'), ('N', 'Network')) v(type_id, description)
LEFT JOIN vuln_references ON cvss_access_vector_id = type_id
""")
def q_join_fanout_lookup(spark, sf_dir):
    return R.exploit_method(tables(spark, sf_dir))


@query("tag_score_case", section="2.2", sql=f"""
WITH {ASSET_TAGS_SQL}
SELECT asset_id, asset_tags, {TAG_CASE_SQL.format(x='asset_tags')} AS tag_score FROM asset_tags
""")
def q_tag_score_case(spark, sf_dir):
    at = R.asset_tags(tables(spark, sf_dir))
    return at.select("asset_id", "asset_tags", tag_score("asset_tags").alias("tag_score"))


@query("sentinel_to_null", section="2.2", sql=f"""
WITH {RISK_CTES}
SELECT asset_id, vulnerability_id, nullif(port, -1) AS ports, -1 AS assigned_asset_category,
       -1 AS calculated_priority FROM fact_asset_vulnerability_instance
""")
def q_sentinel_to_null(spark, sf_dir):
    f = S.fact_asset_vulnerability_instance(tables(spark, sf_dir))
    return f.select("asset_id", "vulnerability_id", sentinel_to_null("port", -1).alias("ports"),
                    F.lit(-1).alias("assigned_asset_category"), F.lit(-1).alias("calculated_priority"))


@query("round_numeric", section="2.6", sql=f"""
WITH {RISK_CTES}
SELECT vulnerability_id, round(CAST(cvss_score AS DECIMAL(38,10)), 1)::DOUBLE AS vuln_cvss FROM dim_vulnerability
""")
def q_round_numeric(spark, sf_dir):
    dv = S.dim_vulnerability(tables(spark, sf_dir))
    return dv.select("vulnerability_id", round_numeric("cvss_score", 1).alias("vuln_cvss"))


@query("html_to_text", section="2.6", sql=f"""
SELECT page_id, {H('html')} AS text FROM pages
""")
def q_html_to_text(spark, sf_dir):
    return tables(spark, sf_dir).pages.select("page_id", html_to_text("html").alias("text"))


@query("join_two_key_on", section="2.3", sql=f"""
WITH {RISK_CTES}
SELECT favi.asset_id, favi.vulnerability_id, favi.port, b.solution_id
FROM fact_asset_vulnerability_instance favi
JOIN dim_asset_vulnerability_best_solution b
  ON favi.asset_id = b.asset_id AND favi.vulnerability_id = b.vulnerability_id
""")
def q_join_two_key_on(spark, sf_dir):
    t = tables(spark, sf_dir)
    f = S.fact_asset_vulnerability_instance(t)
    b = S.dim_asset_vulnerability_best_solution(t)
    return (f.join(b, (f.asset_id == b.asset_id) & (f.vulnerability_id == b.vulnerability_id))
            .select(f.asset_id, f.vulnerability_id, f.port, b.solution_id))
