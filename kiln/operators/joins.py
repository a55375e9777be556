"""Joins Spark has no single operator for: IPv4 range lookup, incremental
manifests and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.net import ipv4_to_long, is_public_ipv4


#: Addresses are swept in buckets of this many low bits: at most 65,536
#: buckets of at most 65,536 distinct addresses each.
SWEEP_BITS = 16


def last_range_at(addresses: DataFrame, ranges: DataFrame, start: str = "start_ip", end: str = "end_ip") -> DataFrame:
    """(addr, range): for each distinct address in ``addr`` the row of
    ``ranges`` that holds it, as a struct, or null.

    An ordered sweep: range starts and addresses are sorted together inside
    buckets of 2**16 addresses, and the last range that started is carried
    forward to each address and checked by its end. A range that began in an
    earlier bucket enters a bucket as a carry row, found from the last start
    of each bucket (at most 65,536 rows). No range is exploded, whatever its
    width. Ranges must be disjoint; a start inside the range before it raises."""
    whole = F.struct(*[F.col(f"`{c}`") for c in ranges.columns])
    bucket = F.shiftright(F.col("addr"), SWEEP_BITS).alias("bucket")
    starts = (ranges.where(F.col(start).isNotNull()).select(F.col(start).cast("long").alias("addr"), whole.alias("range"))
              .select("addr", bucket, F.lit(1).alias("kind"), "range"))
    points = addresses.select("addr", bucket, F.lit(2).alias("kind"), F.lit(None).cast(starts.schema["range"].dataType).alias("range"))
    # per bucket the last start, then over the bounded list of buckets the last one before each
    lasts = (starts.groupBy("bucket").agg(F.max_by("range", "addr").alias("last"))
             .unionByName(points.select("bucket").distinct().withColumn("last", F.lit(None).cast(starts.schema["range"].dataType)))
             .groupBy("bucket").agg(F.first("last", ignorenulls=True).alias("last")))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select("bucket", F.last("last", ignorenulls=True).over(before).alias("range")).select(
        F.shiftleft(F.col("bucket"), SWEEP_BITS).alias("addr"), "bucket", F.lit(0).alias("kind"), "range").where(F.col("range").isNotNull())
    order = Window.partitionBy("bucket").orderBy("addr", "kind")
    earlier = F.last("range", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    swept = starts.unionByName(points).unionByName(carry).select("addr", "kind", "range", earlier.alias("held"))
    clash = F.col(f"held.`{end}`") >= F.col("addr")
    wrong = F.raise_error(F.concat(F.lit("ranges overlap at "), F.col("addr").cast("string"))).cast("boolean")
    # starts are looked at for overlap as they are left out
    asked = F.when(F.col("kind") == 2, F.lit(True)).when((F.col("kind") == 1) & clash, wrong).otherwise(F.lit(False))
    return swept.where(asked).select("addr", F.when(F.col("addr") <= F.col(f"held.`{end}`"), F.col("held")).alias("range"))


def ip_range_join(points: DataFrame, ranges: DataFrame, ip_col: str, start: str = "start_ip", end: str = "end_ip",
                  public_only: bool = True) -> DataFrame:
    """Attach the range row holding each point's IPv4 address.

    Distinct address texts are parsed once and swept against the ranges
    (``last_range_at``); the points then join by text, where a text that many
    points share is a skewed equi-join that AQE splits. Private and reserved
    addresses (and unparsable text) get nulls when ``public_only``. Points
    are never dropped; ranges must be disjoint."""
    number = ipv4_to_long(F.col("__ip"))
    texts = points.select(F.col(f"`{ip_col}`").alias("__ip")).where(F.col("__ip").isNotNull()).distinct().select("__ip", number.alias("addr"))
    texts = texts.where(is_public_ipv4(F.col("addr")) if public_only else F.col("addr").isNotNull())
    found = last_range_at(texts.select("addr").distinct(), ranges, start, end)
    named = texts.join(found.where(F.col("range").isNotNull()), "addr").select("__ip", "range")
    theirs = [c for c in ranges.columns if c not in (start, end)]
    joined = points.alias("p").join(named, F.col(f"p.`{ip_col}`") == F.col("__ip"), "left")
    return joined.select("p.*", *[F.col(f"range.`{c}`").alias(c) for c in theirs])


def incremental_manifest(files: DataFrame, manifest: DataFrame, path_col: str = "path",
                         content_col: str = "content") -> DataFrame:
    """Hash only the files whose path is not yet in the manifest and append
    them: returns manifest rows ∪ new (path, sha256) rows."""
    new = files.join(manifest.select(path_col), path_col, "left_anti")
    hashed = new.select(path_col, F.sha2(F.col(content_col), 256).alias("sha256"))
    return manifest.select(path_col, "sha256").unionByName(hashed)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compare_cols=None) -> DataFrame:
    """added / removed / changed / unchanged per key: one full outer join on
    the key, the compared columns held side by side (null equals null)."""
    cols = compare_cols or [c for c in new.columns if c != key]
    def h(df):
        return df.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("h"), F.lit(True).alias("here"))
    o, n = h(old).alias("o"), h(new).alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    status = (F.when(F.col("o.here").isNull(), "added").when(F.col("n.here").isNull(), "removed")
              .when(~F.col("o.h").eqNullSafe(F.col("n.h")), "changed").otherwise("unchanged"))
    return j.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), status.alias("status"))
