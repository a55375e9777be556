"""Process prevalence reports over endpoint digests.

Distinct-client counts use Spark's single-distinct rewrite: the first
aggregate groups by (keys, client), the second counts per key, both with
map-side partial aggregation, so a hot process does not land whole in one
task. Joins between the per-process list and the (much larger) scoring
table first reduce the scoring side to its distinct (key, attributes)
rows, which the reference's GROUP BY would collapse anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.timefn import recent
from kiln.plans import standins as S
from kiln.sources.tables import Tables

KEYS = ["filename", "pathroot"]


def client_count(t: Tables, customer: str, as_of: str, days: int) -> DataFrame:
    ds = S.digest_system(t)
    return (ds.where((F.col("customer") == customer) & recent("timestamp", as_of, days))
            .agg(F.countDistinct("clientguid").alias("n_clients")))


def customer_prevalence(t: Tables, customer: str = "acme") -> DataFrame:
    di = S.digest_image(t).where(F.col("filename").like("%.exe") & (F.col("customer") == customer))
    lp = S.label_process(t)
    return (di.join(lp, KEYS)
            .groupBy("filename", "demeanor", "customer", "id", "description", "prevelance", "pathroot",
                     "probablecompanyname")
            .agg(F.countDistinct("clientguid").alias("customer_prevalence"))
            .select("filename", "pathroot", "probablecompanyname", "customer_prevalence", "demeanor",
                    F.col("id").alias("label_id"), F.col("prevelance").alias("global_prevalence")))


def autostarted(prev: DataFrame, scoring: DataFrame, min_prevalence: int = 9) -> DataFrame:
    """Processes seen autostarting, grouped with the attribute text as the
    reference does (so one process can appear once per attribute text)."""
    auto = (scoring.where(F.col("extraneousattributes").ilike("%autostart%"))
            .select(*KEYS, "extraneousattributes").distinct())
    cols = prev.columns
    return (prev.where(F.col("customer_prevalence") > min_prevalence)
            .join(auto, KEYS)
            .select(*cols, "extraneousattributes").distinct()
            .select(*cols))


def unlabelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("demeanor") == "NL")


def recent_autostart_executables(t: Tables, as_of: str, days: int = 365) -> DataFrame:
    lp = S.label_process(t).where(F.col("filename").like("%.exe") & (F.col("prevelance") >= 1))
    ds = S.digest_scoring(t).where(recent("timestamp", as_of, days)
                                   & F.col("extraneousattributes").ilike("%autostart%"))
    return lp.join(ds, KEYS).select("pathroot", "filename", "id", "vendorname", "demeanor", "prevelance")


def process_prevalence_report(t: Tables, customer: str = "acme") -> DataFrame:
    """list -> autostarted (prevalence > 9) -> not yet labelled by a human."""
    prev = customer_prevalence(t, customer)
    return unlabelled(autostarted(prev, S.digest_scoring(t)))
