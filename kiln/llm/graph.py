"""Connected components of a link table, by alternating stars.

Large-star and small-star rounds (Kiveris et al. 2014) turn the links into
stars around each component's least node. Every round is groupings with
map-side minima and joins between tables in the shared folder, so nothing is
gathered and a lost executor costs a stage, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node with a link and the least node it can
    reach. Links with a null end and loops are left out."""
    edges = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                   .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    mark = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                       .select("u", F.least("u", "m").alias("m")), "links-least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
                       "links-large")
        parent = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "links-parent")
        moved = large.join(parent, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(moved.unionByName(parent.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
