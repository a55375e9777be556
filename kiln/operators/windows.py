"""Running totals and global ranks without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.sources.sinks import snapshot


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``values`` in ``order``.

    A window with ORDER BY and no PARTITION BY moves every row into one
    task. Here rows are range-partitioned by the order, the lineage is cut
    (written to the shared folder), per-partition totals (one row per partition) give
    each partition its starting offsets, and the running sum inside a
    partition is a window over that partition only."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = snapshot(df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()), "prefix-sums")
    tot = sorted(s.groupBy("__pid").agg(*[F.sum(v).alias(v) for v in values]).collect(), key=lambda r: r["__pid"])
    run = {v: 0 for v in values}
    rows = []
    for r in tot:
        rows.append(tuple([r["__pid"]] + [run[v] for v in values]))
        for v in values:
            run[v] += r[v] or 0
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "__pid int, " + ", ".join(f"__o_{v} {types[v] if types[v] in ('bigint', 'double') else 'double'}"
                                       for v in values)
    off = spark.createDataFrame(rows, schema)
    w = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(off), "__pid")
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"__o_{v}") + F.sum(v).over(w))
    return out.drop("__pid", *[f"__o_{v}" for v in values])


def grouped_prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str],
                        suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``values`` in ``order`` inside each ``group``.

    Rows are range-partitioned by (group, order), so a group of any size is
    spread over tasks; the lineage is cut by writing them. One row
    for each partition and group that meet (at most partitions + groups rows)
    carries the group's sum over earlier partitions. (group, order) must be
    unique."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    s = snapshot(df.repartitionByRange(parts, *keys).withColumn("__pid", F.spark_partition_id()), "prefix-sums")
    totals = s.groupBy("__pid", *keys[:len(group)]).agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy(*keys[:len(group)]).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("__pid").alias("__cp"), *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)],
                            *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy("__pid", *keys[:len(group)]).orderBy(*keys[len(group):]).rowsBetween(Window.unboundedPreceding, 0)
    run = s.select("*", *[F.sum(v).over(inside).alias(f"__r_{v}") for v in values])
    meets = F.col("__pid") == F.col("__cp")
    for i, g in enumerate(group):
        meets = meets & F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    return run.join(carried, meets).select(*[F.col(f"`{c}`") for c in df.columns],
                                           *[(F.col(f"__r_{v}") + F.col(f"__o_{v}")).alias(f"{v}{suffix}") for v in values])
