"""Reference-shaped tables derived from the driver tables with Spark.

The reference's own inputs (vulnerability warehouse, process digests, CRM
opportunities, connection logs, network lists) are not shipped, so each is
re-expressed as a projection/join of the driver tables. Every stand-in grows
with the tables it comes from; the fixed-size dimensions (nation, region)
are the only small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.sources.tables import Tables

# ------------------------------------------------------ vulnerability warehouse


def dim_vulnerability(t: Tables) -> DataFrame:
    p = t.part
    return p.select(
        F.col("p_partkey").alias("vulnerability_id"),
        (F.col("p_size") / F.lit(5.3)).alias("cvss_score"),
        F.when(F.col("p_size") >= 40, "Critical").when(F.col("p_size") >= 25, "Severe")
         .otherwise("Moderate").alias("severity"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("<p>"), F.col("p_name"), F.lit(" &amp; "), F.col("p_type"), F.lit("</p>"))
         .alias("description"),
        (F.col("p_size") % 4).alias("exploits"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "L").when(F.col("p_type") == "PROMO", "A")
         .otherwise("N").alias("cvss_access_vector_id"),
    )


def dim_vulnerability_reference(t: Tables) -> DataFrame:
    src = F.when(F.col("cve"), "CVE").otherwise("BID")
    # dealt by vulnerability before the distinct, in short columns: what joins
    # and groups the references by vulnerability then finds them in place
    refs = t.lineitem.select(F.col("l_partkey").alias("vulnerability_id"), "l_suppkey",
                             F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("cve"))
    return refs.repartition("vulnerability_id").distinct().select(
        "vulnerability_id", src.alias("source"), F.concat(src, F.lit("-"), F.col("l_suppkey").cast("string")).alias("reference"))


def dim_asset(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("asset_id"),
        F.col("c_name").alias("host_name"),
        F.concat(F.lit("10."), F.col("c_nationkey").cast("string"), F.lit("."),
                 (F.col("c_custkey") % 250).cast("string"), F.lit(".1")).alias("ip_address"),
    )


def dim_asset_host_name(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("asset_id"),
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("host_name"),
        F.when(F.col("c_acctbal") >= 0, "N").otherwise("D").alias("source_type_id"),
    )


def dim_tag(t: Tables) -> DataFrame:
    hv = t.nation.select(F.col("n_nationkey").alias("tag_id"),
                         F.concat(F.lit("HV"), (F.col("n_nationkey") % 12).cast("string")).alias("tag_name"))
    reg = t.region.select((F.col("r_regionkey") + 100).alias("tag_id"), F.col("r_name").alias("tag_name"))
    return hv.unionByName(reg)


def dim_tag_asset(t: Tables) -> DataFrame:
    c = t.customer
    by_nation = c.where(F.col("c_acctbal") >= -500).select(
        F.col("c_nationkey").alias("tag_id"), F.col("c_custkey").alias("asset_id"))
    by_region = (c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
                 .join(t.nation, c.c_nationkey == t.nation.n_nationkey)
                 .select((F.col("n_regionkey") + 100).alias("tag_id"), F.col("c_custkey").alias("asset_id")))
    return by_nation.unionByName(by_region)


def dim_asset_vulnerability_best_solution(t: Tables, fact: DataFrame | None = None) -> DataFrame:
    """``fact``: the instance table, where the caller holds it already."""
    fact = fact_asset_vulnerability_instance(t) if fact is None else fact
    # dealt by asset alone: a join by asset and vulnerability is served by it too
    return (fact.select("asset_id", "vulnerability_id").repartition("asset_id").distinct()
            .withColumn("solution_id", (F.col("vulnerability_id") % 5).cast("int")))


def dim_solution(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("solution_id"),
                           F.concat(F.lit("<li>Apply vendor patch for "), F.col("r_name"),
                                    F.lit("</li>")).alias("fix"))


def dim_cvss_access_vector(t: Tables) -> DataFrame:
    return t.region.where(F.col("r_regionkey") < 3).select(
        F.element_at(F.array(F.lit("L"), F.lit("A"), F.lit("N")), F.col("r_regionkey") + 1).alias("type_id"),
        F.element_at(F.array(F.lit("Local"), F.lit("Adjacent Network"), F.lit("Network")),
                     F.col("r_regionkey") + 1).alias("description"))


def dim_protocol(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("protocol_id"),
                           F.element_at(F.array(*[F.lit(x) for x in ["TCP", "UDP", "ICMP", "TCP", "UDP"]]),
                                        F.col("r_regionkey") + 1).alias("name"))


def dim_service(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("service_id"))


def fact_asset_vulnerability_instance(t: Tables) -> DataFrame:
    li, o = t.lineitem, t.orders
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("asset_id"),
        F.col("l_partkey").alias("vulnerability_id"),
        (F.col("l_linenumber") % 5).alias("protocol_id"),
        (F.col("l_suppkey") % 25).cast("int").alias("service_id"),
        F.when(F.col("l_linestatus") == "O", F.lit(-1)).otherwise(F.col("l_linenumber") + 1000).alias("port"),
        F.concat(F.lit("<b>qty</b> "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" &gt; "),
                 F.col("l_returnflag")).alias("proof"),
    )


# ------------------------------------------------------------ process digests

def _filename() -> F.Column:
    return F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"),
                    F.col("p_partkey").cast("string"),
                    F.when(F.col("p_type").isin("SMALL", "PROMO"), F.lit(".dll")).otherwise(F.lit(".exe")))


def _pathroot() -> F.Column:
    return F.when(F.col("p_size") == 1, F.lit(None).cast("string")).otherwise(F.col("p_brand"))


def _customer() -> F.Column:
    return F.when(F.col("l_returnflag") == "R", F.lit("acme")).otherwise(F.lit("globex"))


def digest_image(t: Tables) -> DataFrame:
    li, p = t.lineitem, t.part
    return li.join(p, li.l_partkey == p.p_partkey).select(
        _filename().alias("filename"), _pathroot().alias("pathroot"),
        F.col("p_type").alias("probablecompanyname"), F.col("l_suppkey").alias("clientguid"),
        _customer().alias("customer"))


def digest_system(t: Tables) -> DataFrame:
    return t.lineitem.select(_customer().alias("customer"), F.col("l_suppkey").alias("clientguid"),
                             F.col("l_shipdate").alias("timestamp"))


def label_process(t: Tables) -> DataFrame:
    p = t.part
    base = p.select(F.col("p_partkey").alias("id"), _filename().alias("filename"), _pathroot().alias("pathroot"),
                    F.when(F.col("p_retailprice") < 950, "NL").otherwise("GOOD").alias("demeanor"),
                    F.col("p_name").alias("description"), F.col("p_brand").alias("vendorname"),
                    F.col("p_size").alias("prevelance"))
    # a second, conflicting label for the largest parts: duplicate keys with
    # different attributes, as a re-labelled process has
    relabel = p.where(F.col("p_size") >= 48).select(
        (F.col("p_partkey") + 1_000_000_000).alias("id"), _filename().alias("filename"),
        _pathroot().alias("pathroot"), F.lit("BAD").alias("demeanor"), F.col("p_name").alias("description"),
        F.col("p_brand").alias("vendorname"), F.col("p_size").alias("prevelance"))
    return base.unionByName(relabel)


def digest_scoring(t: Tables) -> DataFrame:
    li, p = t.lineitem, t.part
    attrs = (F.when(F.col("l_linestatus") == "O", F.lit("run;AUTOSTART;svc"))
             .when(F.col("l_returnflag") == "A", F.lit("manual"))
             .otherwise(F.lit("Autostart-delayed")))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        _filename().alias("filename"), _pathroot().alias("pathroot"),
        attrs.alias("extraneousattributes"), F.col("l_shipdate").alias("timestamp"))


# ------------------------------------------------------------------- e-mails

def emails(t: Tables) -> DataFrame:
    """Addresses: one per customer (with the awkward spellings a real table
    has) plus every address written in a document."""
    c = t.customer
    local = F.lower(F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("cust")))
    domain = F.concat(F.lit("mail"), F.col("c_nationkey").cast("string"),
                      F.when(F.col("c_nationkey") % 5 == 3, F.lit(".co.uk")).otherwise(F.lit(".com")))
    seg = F.col("c_mktsegment")
    email = (F.when(F.col("c_acctbal") < -900, F.lit(None).cast("string"))
             .when(seg == "AUTOMOBILE", F.concat(local, F.lit(" at "), domain))
             .when(seg == "BUILDING", F.concat(F.lit("  "), F.upper(local), F.lit("@"), F.upper(domain), F.lit(" ")))
             .when(seg == "FURNITURE", F.concat(local, F.lit("@"), local, F.lit("@"), domain))
             .when((seg == "HOUSEHOLD") & (F.col("c_acctbal") < 0), F.concat(local, F.lit("@bcde")))
             .otherwise(F.concat(local, F.lit("@"), domain)))
    from_customers = c.select(F.col("c_custkey").alias("email_id"), email.alias("email"))
    # every address contains '@': a substring test skips the regex on texts without one
    found = t.documents.where(F.col("text").contains("@")).select(
        (-F.col("doc_id") - 1).alias("email_id"),
        F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), 1))
         .alias("email"))
    return from_customers.unionByName(found)


# ------------------------------------------------------------ connection log

def conn_log(t: Tables) -> DataFrame:
    """Connection records (the log's columns, dotted names included) from
    ``events``: one connection per event."""
    e = t.events
    et = F.col("event_type")
    eid, uid = F.col("event_id"), F.col("user_id")
    resp_p = (F.when(et == "view", 80).when(et == "click", 443).when(et == "purchase", 8443)
              .when(et == "signup", 0).otherwise(F.pmod(uid * 31, F.lit(65536))))
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("ts"),
        F.concat(F.lit("C"), eid.cast("string")).alias("uid"),
        F.concat(F.lit("192.168.1."), (uid % 250 + 1).cast("string")).alias("id.orig_h"),
        F.pmod(eid * 7919, F.lit(65536)).cast("int").alias("id.orig_p"),
        F.concat_ws(".", ((eid * 37) % 256).cast("string"), ((eid * 91) % 256).cast("string"),
                    ((uid * 13) % 256).cast("string"), (eid % 256).cast("string")).alias("id.resp_h"),
        resp_p.cast("int").alias("id.resp_p"),
        F.when(et.isin("view", "click"), "tcp").when(et == "error", "icmp").otherwise("udp").alias("proto"),
        F.when(et.isin("view", "purchase"), F.lit("http")).when(et == "click", F.lit("ssl")).alias("service"),
        F.when(et != "error", F.col("value") / 10.0).alias("duration"),
        (F.col("value") * 100).cast("long").alias("orig_bytes"),
        (F.col("value") * 37).cast("long").alias("resp_bytes"),
        ((F.col("value") * 100).cast("long") % 7 * 5000).alias("missed_bytes"),
        (uid % 20 + 1).alias("orig_pkts"),
        ((F.col("value") * 100).cast("long") + 40 * (uid % 20 + 1)).alias("orig_ip_bytes"),
        (eid % 150).alias("resp_pkts"),
        ((F.col("value") * 37).cast("long") + 40 * (eid % 150)).alias("resp_ip_bytes"),
        F.when(uid % 50 == 0, F.concat(F.lit("T"), uid.cast("string"))).alias("tunnel_parents"),
        F.when(uid == 0, F.lit(None).cast("string")).when(et == "error", F.lit("Malicious   C&C"))
         .when(et == "signup", F.lit("Malicious   DDoS")).otherwise(F.lit("Benign")).alias("label"),
    )


# ------------------------------------------------------------------ network

def _mac_hex() -> F.Column:
    return F.lpad(F.hex(F.pmod(F.col("s_suppkey") * 2654435761, F.lit(281474976710656))), 12, "0")


def expected_hosts(t: Tables) -> DataFrame:
    s = t.supplier
    h = _mac_hex()
    pairs = [F.substring(h, i, 2) for i in range(1, 13, 2)]
    mac = (F.when(F.col("s_acctbal") < 0, F.concat(F.lit("zz"), F.substring(h, 3, 10)))
           .when(F.col("s_nationkey") % 4 == 0, F.upper(F.concat_ws("-", *pairs)))
           .otherwise(F.lower(F.concat_ws(":", *pairs))))
    return s.select(
        F.col("s_suppkey").alias("host_id"), mac.alias("mac"),
        # one address for each supplier, as far as four octets reach
        F.concat_ws(".", (F.expr("s_suppkey div 16777216") % 100 + 10).cast("string"), (F.expr("s_suppkey div 65536") % 256).cast("string"),
                    (F.expr("s_suppkey div 256") % 256).cast("string"), (F.col("s_suppkey") % 256).cast("string")).alias("ip"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))), F.lit(".corp.example.com"))
         .alias("fqdn"))


def arp_table(t: Tables) -> DataFrame:
    e = expected_hosts(t).join(t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey"),
                               F.col("host_id") == F.col("s_suppkey"))
    live = e.where(F.col("s_acctbal") > 0)
    return live.select(
        F.lower(F.translate(F.col("mac"), "-", ":")).alias("mac"),
        F.when(F.col("s_nationkey") == 7, F.concat(F.lit("10.9.9."), (F.col("host_id") % 250).cast("string")))
         .otherwise(F.col("ip")).alias("ip"),
        F.substring_index(F.col("fqdn"), ".", 1).alias("host"))


def dns_a(t: Tables) -> DataFrame:
    e = expected_hosts(t).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("host_id") == F.col("s_suppkey"))
    return e.where(F.col("s_nationkey") != 5).select(
        F.when(F.col("s_nationkey") == 2, F.upper("fqdn")).otherwise(F.col("fqdn")).alias("fqdn"),
        F.when(F.col("s_nationkey") == 9, F.lit("10.8.8.8")).otherwise(F.col("ip")).alias("ip"))


def dns_ptr(t: Tables) -> DataFrame:
    e = expected_hosts(t).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("host_id") == F.col("s_suppkey"))
    return e.where(F.col("s_nationkey") != 6).select(
        "ip", F.when(F.col("host_id") % 2 == 0, F.concat(F.col("fqdn"), F.lit("."))).otherwise(F.col("fqdn"))
        .alias("host"))


def ip_ranges(t: Tables) -> DataFrame:
    """Network ranges (start, end, country, asn): each nation owns ten /8
    blocks; generated from the nation keys."""
    n = t.nation
    start = (F.col("n_nationkey") * 10).cast("long") * F.lit(16777216)
    return n.select(start.alias("start_ip"), (start + F.lit(10 * 16777216 - 1)).alias("end_ip"),
                    F.col("n_name").alias("country"), (F.col("n_nationkey") + 64512).cast("long").alias("asn"))


def document_ips(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"), 1))
        .alias("ip"))


# ------------------------------------------------------ CRM opportunities

def opportunities(t: Tables) -> DataFrame:
    """Sales opportunities: one per order, with the CRM's column names, a
    JSON formula column and a pipe-delimited product."""
    o, c, n, r = t.orders, t.customer, t.nation, t.region
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    qtr = F.quarter("o_orderdate")
    prod = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("managed_service|A|"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("product|B|saas_platform"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("product|C|on_prem"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("")))
    formulas = F.to_json(F.struct(qtr.alias("quarter_created"),
                                  (F.pmod(qtr + F.col("o_custkey") % 3 - 1, F.lit(4)) + 1).alias("quarter_closed"),
                                  prod.alias("primary_product"),
                                  (F.col("c_acctbal") > 5000).alias("partner_involved")))
    return j.select(
        F.concat(F.lit("OPP-"), F.col("o_orderkey").cast("string")).alias("CRM Identifier"),
        F.col("c_mktsegment").alias("Industry"),
        F.concat(F.lit("REP"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0")).alias("Sales Rep ID"),
        F.when(F.col("c_nationkey") == 24, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("r_name"), F.lit(" - "), F.col("n_name"))).alias("Sales team name"),
        (F.month("o_orderdate") % 8).alias("Num times opp pushed"),
        (F.dayofyear("o_orderdate") * 2).alias("Age of opp in days"),
        F.when(F.col("c_acctbal") < -900, F.lit(None).cast("long"))
         .otherwise(F.col("o_totalprice").cast("long")).alias("Deal size (USD)"),
        F.when(F.col("o_orderstatus") == "F", F.lit(True)).when(F.col("o_orderstatus") == "O", F.lit(False))
         .alias("Won"),
        formulas.alias("array_of_sfdc_formulas"))
