"""Per-pair connection features: first contact, trailing 24 h volume,
byte ratios and service/port checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.windows import grouped_prefix_sums

# Service -> (protocol, port) expected for it.
SERVICE_PORTS = [("http", "tcp", 80), ("ssl", "tcp", 443), ("dns", "udp", 53), ("ssh", "tcp", 22)]


def first_contact(df: DataFrame, pair: Sequence[str], ts: str, tiebreak: str) -> DataFrame:
    """First connection of each pair. A grouped min over (ts, tiebreak)
    instead of a window: partial aggregation keeps a hot pair from landing
    whole in one task."""
    cols = [c for c in df.columns if c not in pair]
    first = F.min(F.struct(F.col(f"`{ts}`"), F.col(f"`{tiebreak}`"),
                           *[F.col(f"`{c}`").alias(c) for c in cols if c not in (ts, tiebreak)]))
    g = df.groupBy(*[F.col(f"`{p}`") for p in pair]).agg(first.alias("f"))
    return g.select(*[F.col(f"`{p}`") for p in pair], *[F.col("f")[c].alias(c) for c in cols])


def trailing_sum(df: DataFrame, pair: Sequence[str], ts: str, value, seconds: float,
                 out: str = "sum_window") -> DataFrame:
    """Sum of ``value`` over each row's pair in [ts - seconds, ts], linear in the rows.

    Values are summed per (pair, ts) first. A sum enters the window at its ts
    and leaves it just after ts + seconds, so the trailing sum is a running
    total over enter and leave rows in time order. Running totals go across
    range partitions, so a busy pair (or a busy day of it) is many tasks.
    Rows of null ts form a window of their own. Whole numbers and decimals are
    exact; doubles carry the rounding of adding and taking away."""
    v = value if not isinstance(value, str) else F.col(value)
    keys = [f"__k{i}" for i in range(len(pair))]
    named = [F.col(f"`{p}`").alias(k) for p, k in zip(pair, keys)]
    sums = (df.select(*named, F.col(f"`{ts}`").alias("__at"), v.alias("__v")).groupBy(*keys, "__at")
            .agg(F.coalesce(F.sum("__v"), F.lit(0)).alias("__s"), F.count("__v").alias("__n")))
    at, s, n = F.col("__at"), F.col("__s"), F.col("__n")
    moves = sums.where(at.isNotNull()).select(*keys, F.explode(F.array(
        F.struct(at.alias("at"), F.lit(0).alias("leaves"), s.alias("s"), n.alias("n")),
        F.struct((at + F.lit(seconds)).cast(sums.schema["__at"].dataType).alias("at"), F.lit(1).alias("leaves"),
                 (-s).alias("s"), (-n).alias("n")))).alias("m")).select(*keys, "m.*")
    run = grouped_prefix_sums(moves, keys, ["at", "leaves"], ["s", "n"])
    total = lambda n, s: F.when(F.col(n) > 0, F.col(s)).alias(out)
    found = run.where(F.col("leaves") == 0).select(*keys, F.col("at").alias("__at"), total("n_cum", "s_cum"))
    found = found.unionByName(sums.where(at.isNull()).select(*keys, "__at", total("__n", "__s")))
    meets = F.col(f"d.`{ts}`").eqNullSafe(F.col("__at"))
    for p, k in zip(pair, keys):
        meets = meets & F.col(f"d.`{p}`").eqNullSafe(F.col(k))
    return df.alias("d").join(found, meets).select("d.*", out)


def ratio(num, den):
    """num / den, null when den is 0 or null."""
    return F.when(den != 0, num / den)


def service_port_mismatch(df: DataFrame, service: str, proto: str, port: str) -> DataFrame:
    """Flag records whose protocol/port disagree with the service's expected
    pair. The map is a fixed literal of a few rows, so broadcasting it is
    bounded by construction."""
    spark = df.sparkSession
    m = spark.createDataFrame(SERVICE_PORTS, "svc string, exp_proto string, exp_port int")
    j = df.join(F.broadcast(m), F.col(f"`{service}`") == F.col("svc"), "left")
    mismatch = F.when(F.col("svc").isNull(), F.lit(None).cast("boolean")).otherwise(
        (F.col(f"`{proto}`") != F.col("exp_proto")) | (F.col(f"`{port}`") != F.col("exp_port")))
    return j.withColumn("mismatch", mismatch).drop("svc")
