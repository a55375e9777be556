"""Custom vulnerability risk-score report, one function per CTE.

Plan shape: the two pre-aggregations (references per vulnerability, tags per
asset) are written before the fact join, as the report does by hand, so the
large instance table meets already-aggregated dimensions. Join strategies
are AQE's choice: the small dimensions become broadcasts from runtime sizes,
the big ones stay sort-merge with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.strings import html_to_text, round_numeric, tag_score
from kiln.plans import standins as S
from kiln.sources.tables import Tables


def filtered_string_agg(value: str, predicate: str, sep: str = ", ") -> F.Column:
    """Sorted string aggregate over rows passing ``predicate``; null when none pass."""
    return F.expr(f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {value}) FILTER (WHERE {predicate})")


def sorted_string_agg(value: str, sep: str = ", ") -> F.Column:
    """Sorted string aggregate, nulls skipped; '' for a group with no values."""
    return F.array_join(F.array_sort(F.collect_list(F.col(value))), sep)


def vuln_references(t: Tables, keep_orphans: bool = True) -> DataFrame:
    """References per vulnerability: CVE list and other references.

    ``keep_orphans`` keeps the reference's LEFT JOIN: references without a
    vulnerability form one group with null attributes. The report drops that
    group in its inner join, so it asks for the inner form.
    """
    dvr = S.dim_vulnerability_reference(t)
    dv = S.dim_vulnerability(t).withColumnRenamed("vulnerability_id", "dv_id")
    j = dvr.join(dv, dvr.vulnerability_id == dv.dv_id, "left" if keep_orphans else "inner")
    return (j.groupBy("dv_id", "cvss_score", "severity", "title", "description", "exploits",
                      "cvss_access_vector_id")
            .agg(filtered_string_agg("reference", "source = 'CVE'").alias("cves"),
                 filtered_string_agg("reference", "source <> 'CVE'").alias("other_references"))
            .select(F.col("dv_id").alias("vulnerability_id"),
                    round_numeric("cvss_score", 1).alias("vuln_cvss"),
                    F.col("severity").alias("vuln_severity"),
                    F.col("title").alias("vuln_name"),
                    "description", F.col("exploits").alias("exploitability"),
                    "cvss_access_vector_id", "cves", "other_references"))


def netbios_assets(t: Tables) -> DataFrame:
    return (S.dim_asset_host_name(t).where(F.col("source_type_id") == "N")
            .select("asset_id", F.col("host_name").alias("netbios_name")))


def asset_tags(t: Tables) -> DataFrame:
    da, dta, dt = S.dim_asset(t), S.dim_tag_asset(t), S.dim_tag(t)
    return (da.join(dta, "asset_id", "left")
            .join(dt, "tag_id", "left")
            .join(netbios_assets(t), "asset_id", "left")
            .groupBy("asset_id", "host_name", "ip_address", "netbios_name")
            .agg(sorted_string_agg("tag_name").alias("asset_tags")))


def asset_vulnerability_solution(t: Tables, fix_as_text: bool = False, fact: DataFrame | None = None) -> DataFrame:
    sol = S.dim_solution(t)
    if fix_as_text:  # convert each solution once, before it fans out over (asset, vulnerability)
        sol = sol.withColumn("fix", html_to_text("fix"))
    return (S.dim_asset_vulnerability_best_solution(t, fact)
            .join(sol, "solution_id")
            .select("asset_id", "vulnerability_id", "solution_id", F.col("fix").alias("vuln_solution")))


def exploit_method(t: Tables) -> DataFrame:
    """Access vector LEFT JOIN vulnerability: one row per (vector, vulnerability)."""
    dcav = S.dim_cvss_access_vector(t)
    dv = S.dim_vulnerability(t).select("vulnerability_id", "cvss_access_vector_id")
    # a left join would gather the vulnerabilities by their few vectors; an
    # inner join lets the small side be broadcast, and the vectors without a
    # vulnerability are added by themselves
    found = dv.join(dcav, dcav.type_id == dv.cvss_access_vector_id).select("type_id", "description", "vulnerability_id")
    used = dv.select(F.col("cvss_access_vector_id").alias("type_id")).distinct()
    return found.unionByName(dcav.join(used, "type_id", "left_anti").select(
        "type_id", "description", F.lit(None).cast(dv.schema["vulnerability_id"].dataType).alias("vulnerability_id")))


def risk_score_report(t: Tables) -> DataFrame:
    # the solutions' (asset, vulnerability) pairs come from a second join of
    # their own, pruned to the keys: reading three key columns again costs less
    # than writing the fact table whole
    favi = S.fact_asset_vulnerability_instance(t)
    at = asset_tags(t)
    # markup is converted per vulnerability / per solution before the joins,
    # not once per instance row after them
    vr = vuln_references(t, keep_orphans=False).withColumn("vuln_text", html_to_text("description"))
    avs = asset_vulnerability_solution(t, fix_as_text=True)
    # The report's final ON names a table out of scope; it is bound to the
    # vulnerability's access vector, and the lookup is kept one row per type
    # so the fact is not multiplied by every vulnerability of that type.
    em = S.dim_cvss_access_vector(t)
    # solutions and tags join while the instances are narrow, in one partitioning
    # by asset; the long texts of a vulnerability join last and are not moved again
    j = (favi.repartition("asset_id").join(avs, ["asset_id", "vulnerability_id"])
         .join(at, "asset_id")
         .join(vr, "vulnerability_id")
         .join(S.dim_protocol(t), "protocol_id")
         .join(em, vr.cvss_access_vector_id == em.type_id, "left")
         .join(S.dim_service(t), "service_id", "left"))
    return j.select(
        F.col("vulnerability_id").alias("pluginid"), "cves", "vuln_cvss", "type_id",
        em.description.alias("description"), "asset_tags",
        (F.col("vuln_cvss") + tag_score("asset_tags")).alias("prospect_custom_risk"),
        "vuln_severity", F.col("host_name").alias("host"), "ip_address", "netbios_name",
        "asset_id", F.col("name").alias("protocol"),
        F.when(F.col("port") == -1, F.lit(None)).otherwise(F.col("port")).alias("ports"),
        "vuln_name",
        F.col("vuln_text").alias("vuln_synopsis"),
        F.col("vuln_text").alias("vuln_description"),
        F.col("vuln_solution").alias("solution"),
        F.col("other_references").alias("see_also_additional_resources"),
        html_to_text("proof").alias("plugin_output_proof"),
        "exploitability",
        F.lit(-1).alias("assigned_asset_category"), F.lit(-1).alias("calculated_priority"),
        F.lit(-1).alias("remediation_assignee"), F.lit(-1).alias("fields_for_query"),
    )
