"""Reproducible sampling: exact-size resampling with replacement, hash
shuffles and splits, stratified samples.

Draw ``i`` of a seeded resample picks row
``conv(substr(md5(seed || ':' || i), 1, 8), 16, 10) mod n``. The draws are a
distributed ``spark.range`` counted per picked index, joined to an exact
global row index; nothing is collected except per-partition counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.quantiles import order_statistics
from kiln.sources.sinks import snapshot


def _c(name: str) -> Column:
    return F.col(name if name.startswith("`") else f"`{name}`")


def hash_unit(seed, *cols) -> Column:
    """Deterministic value in [0, 1) from md5(seed:cols)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_long(seed, *cols, digits: int = 15) -> Column:
    """First ``digits`` hex digits of md5(seed:cols) as a long (13 digits =
    52 bits stay exact when carried as a double)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[(_c(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


def _spelled(df: DataFrame, name: str) -> Column:
    """A column as it enters a row's hash: fractions as whole millionths, whose
    spelling does not depend on an engine's way of writing doubles."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return F.round(c * 1_000_000).cast("long") if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def global_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_index",
                 keep_partition: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Exact 0-based position of each row in ``order_cols`` order; with
    ``keep`` only these columns are written beside the position.

    One range exchange: the rows are sorted inside their range partition,
    numbered there (partition id in the high bits) and written to the shared
    folder, which fixes partition and place. One small row per partition,
    its count, reaches the driver and gives each partition its offset.
    ``order_cols`` should be unique."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [_c(c) for c in order_cols]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    s = (snapshot(placed if keep is None else placed.select(*[_c(c) for c in keep], "__at"), "global-index")
         .withColumn("__pid", F.shiftright("__at", 33).cast("int")))
    counts = sorted((r["__pid"], r["n"]) for r in s.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid, n in counts:
        offsets.append((pid, run))
        run += n
    off = spark.createDataFrame(offsets, "__pid int, __off long")  # one row per partition
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (s.join(F.broadcast(off), "__pid").withColumn(name, F.col("__off") + place)
            .drop("__at", *(["__off"] if keep_partition else ["__pid", "__off"])))


#: Small whole numbers that share one sort column: nine bits each.
PACKED = 7


def packed_order(df: DataFrame, order_cols: Sequence[str]) -> list[Column]:
    """Sort columns that order rows as ``order_cols`` do (nulls first), with
    runs of one-byte columns (flags) packed seven to a long."""
    out, run = [], []

    def flush() -> None:
        while run:
            some = [run.pop(0) for _ in range(min(PACKED, len(run)))]
            total = F.lit(0).cast("long")
            for c in some:
                total = total * 512 + F.coalesce(c.cast("long") + 129, F.lit(0))
            out.append(total)

    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in order_cols:
        name = name.strip("`")
        if isinstance(kinds[name], (T.ByteType, T.BooleanType)):
            run.append(F.col(f"`{name}`").cast("tinyint"))
        else:
            flush()
            out.append(F.col(f"`{name}`"))
    flush()
    return out


def resample_exact(df: DataFrame, n_samples: int, order_cols: Sequence[str], seed=123456,
                   n_rows: int | None = None) -> DataFrame:
    """Exactly ``n_samples`` rows drawn with replacement, reproducibly.

    The rows are written once with a row number (``__row``; rows that carry
    one are taken as written). Only the sort columns and the number are sorted,
    and only the number is indexed; the draws, counted per index, join that
    narrow index, and the rows join last, by their number."""
    spark = df.sparkSession
    n = n_rows if n_rows is not None else df.count()
    if n == 0 or n_samples <= 0:
        return df.limit(0).drop("__row")
    # the row number as last sort key keeps a heavily repeated row from filling
    # one range partition; identical rows are interchangeable, so draws are unchanged
    rows = df if "__row" in df.columns else snapshot(df.withColumn("__row", F.monotonically_increasing_id()), "resample-rows")
    keys = packed_order(rows, order_cols)
    narrow = rows.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], "__row")
    indexed = global_index(narrow, [f"__k{i}" for i in range(len(keys))] + ["__row"], "__idx", keep=["__row"]).select("__idx", "__row")
    draws = spark.range(n_samples).select(
        F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10)
               .cast("long"), F.lit(n)).alias("__idx"))
    mult = draws.groupBy("__idx").agg(F.count(F.lit(1)).alias("__k"))
    picked = indexed.join(mult, "__idx").select("__row", "__k")
    j = rows.join(picked, "__row")
    return (j.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.col("__k").cast("int"))))
            .select(*[F.col(f"`{c}`") for c in df.columns if c != "__row"]))


def upsample_class(df: DataFrame, label: str, positive=1, factor: float = 1.6, order_cols=None,
                   seed=123456) -> DataFrame:
    """Positives resampled with replacement to int(factor * n_pos), then all
    other rows appended. The input is written once with row numbers (it is read
    by the count, the resample and the append), which also cuts its lineage."""
    rows = snapshot(df.withColumn("__row", F.monotonically_increasing_id()), "upsample-input")
    pos = rows.where(F.col(label) == positive)
    rest = rows.where(~(F.col(label) == positive) | F.col(label).isNull()).drop("__row")
    n_pos = pos.count()
    up = resample_exact(pos, int(n_pos * factor), order_cols or df.columns, seed, n_rows=n_pos)
    return up.unionByName(rest)


def resample_to_match(df: DataFrame, label: str, take, match, order_cols=None, seed=123456) -> DataFrame:
    """Class ``take`` resampled with replacement to the size of class
    ``match``; all rows of ``match`` appended (down- or up-sampling)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    src = df.where(F.col(label) == take)
    other = df.where(F.col(label) == match)
    res = resample_exact(src, counts.get(match, 0), order_cols or df.columns, seed, n_rows=counts.get(take, 0))
    return res.unionByName(other)


def downsample_to_match(df, label, majority, minority, **kw):
    return resample_to_match(df, label, majority, minority, **kw)


def upsample_to_match(df, label, minority, majority, **kw):
    return resample_to_match(df, label, minority, majority, **kw)


def shuffle_rows(df: DataFrame, key_cols: Sequence[str], seed=123456, key_name: str | None = None) -> DataFrame:
    """Seeded random order that is stable across runs (sort by a hash);
    ``key_name`` keeps the hash as a column."""
    keyed = df.withColumn(key_name or "__shuffle", hash_long(seed, *[_spelled(df, c.strip("`")) for c in key_cols]))
    out = keyed.orderBy(key_name or "__shuffle", *[_c(c) for c in key_cols])
    return out if key_name else out.drop("__shuffle")


def train_test_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float, seed=123456,
                     col: str = "split") -> DataFrame:
    """Stable split by a hash of the key: same rows land in the same side on
    every run and partitioning."""
    return df.withColumn(col, F.when(hash_unit(seed, *key_cols) < F.lit(test_fraction), "test")
                         .otherwise("train"))


def stratified_sample(df: DataFrame, label: str, fractions: Mapping, key_cols: Sequence[str],
                      seed=123456) -> DataFrame:
    """Exactly floor(fraction * n_class) rows per class: the rows with the
    smallest seeded hashes. The per-class cut-off hash is an exact order
    statistic found without sorting any class in one task."""
    h = hash_long(seed, *key_cols, digits=13)
    base = df.withColumn("__h", h)
    counts = {r[0]: r[1] for r in base.groupBy(label).count().collect()}  # one row per class
    cols, want, classes = {}, {}, {}
    for i, (cls, frac) in enumerate(fractions.items()):
        k = int(frac * counts.get(cls, 0))
        if k > 0:
            name = f"__c{i}"
            cols[name] = F.when(F.col(label) == F.lit(cls), F.col("__h"))
            want[name] = {k - 1}
            classes[name] = (cls, k)
    if not want:
        return df.limit(0)
    stats = order_statistics(base.withColumns(cols), want)
    cond = F.lit(False)
    for name, (cls, k) in classes.items():
        cond = cond | ((F.col(label) == F.lit(cls)) & (F.col("__h") <= F.lit(int(stats[name][k - 1]))))
    return base.where(cond).drop("__h")
