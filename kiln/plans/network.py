"""Network inventory: expected (MAC, IP, FQDN) against observed ARP,
forward and reverse DNS tables. Three left joins on normalised keys; every
observation table is deduplicated on its join key first so the expected
list is never multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.net import mac_normalise, short_hostname
from kiln.operators.relational import anti_join_missing
from kiln.plans import standins as S
from kiln.sources.tables import Tables


def _flag(observed: F.Column, expected: F.Column, missing: str) -> F.Column:
    return (F.when(observed.isNull(), F.lit(missing))
            .when(F.lower(observed) == F.lower(expected), F.lit("Y")).otherwise(F.lit("N")))


def network_inventory_report(t: Tables) -> DataFrame:
    exp = S.expected_hosts(t).select("host_id", mac_normalise("mac").alias("mac_norm"),
                                     (~F.col("mac").rlike(r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"))
                                     .alias("mac_error"), "ip", "fqdn",
                                     short_hostname("fqdn").alias("short_host"))
    arp = (S.arp_table(t).select(mac_normalise("mac").alias("arp_mac"), F.col("ip").alias("arp_ip"))
           .groupBy("arp_mac").agg(F.min("arp_ip").alias("arp_ip")))
    fwd = (S.dns_a(t).select(F.lower("fqdn").alias("fwd_fqdn"), F.col("ip").alias("fwd_ip"))
           .groupBy("fwd_fqdn").agg(F.min("fwd_ip").alias("fwd_ip")))
    rev = (S.dns_ptr(t).select(F.col("ip").alias("rev_ip"),
                               F.lower(F.regexp_replace("host", r"\.$", "")).alias("rev_host"))
           .groupBy("rev_ip").agg(F.min("rev_host").alias("rev_host")))
    j = (exp.join(arp, exp.mac_norm == arp.arp_mac, "left")
         .join(fwd, F.lower(exp.fqdn) == fwd.fwd_fqdn, "left")
         .join(rev, exp.ip == rev.rev_ip, "left"))
    live = F.col("arp_mac").isNotNull()
    return j.select(
        "host_id", "mac_norm", "mac_error", "ip", "short_host",
        F.when(live, "Y").otherwise("N").alias("live"),
        F.when(~live, F.lit("not live")).when(F.col("arp_ip") == F.col("ip"), "Y").otherwise("N").alias("ip_match"),
        _flag(F.col("fwd_ip"), F.col("ip"), "NR").alias("fwd_dns"),
        _flag(F.col("rev_host"), F.col("fqdn"), "NR").alias("rev_dns"))


def hosts_not_live(t: Tables) -> DataFrame:
    exp = S.expected_hosts(t).withColumn("mac_norm", mac_normalise("mac"))
    arp = S.arp_table(t).withColumn("mac_norm", mac_normalise("mac"))
    return anti_join_missing(exp, arp, "mac_norm").select("host_id", "mac", "ip", "fqdn")
