"""Profiling: one aggregate pass per question, long (column, stat, value)
outputs, no per-column jobs.

Wide profiles are computed as a single ``agg`` whose one-row result is
unpivoted with ``stack``; that row is bounded by the number of columns,
never by the data. Per-value questions (distinct counts, top values) unpivot
the data to (column, value) and group once, so map-side partial aggregation
collapses repeated values before the shuffle and a hot value is just one
partially-aggregated row per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.quantiles import exact_quantiles, level0_splits
from kiln.operators.relational import numeric_columns
from kiln.operators.windows import prefix_sums


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _unpivot_row(df: DataFrame, pairs: Sequence[tuple[str, str, Column]], value_type="double") -> DataFrame:
    """One aggregate row -> long rows (column, stat, value)."""
    exprs = [e.cast(value_type).alias(f"v{i}") for i, (_, _, e) in enumerate(pairs)]
    row = df.agg(*exprs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"), F.col(f"v{i}").alias("value"))
                    for i, (c, s, _) in enumerate(pairs)])
    return row.select(F.inline(arr))


def _value(df: DataFrame, c: str) -> Column:
    """Numeric value with NaN treated as missing (pandas' rule)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(q(c)), q(c))
    return q(c)


def numeric_moments(df: DataFrame, cols: Sequence[str], with_splits: bool = False) -> dict[str, dict]:
    """count/mean/std(n-1)/std(n)/min/max for every column in one pass;
    null and NaN are both missing. ``with_splits`` folds the first level of
    the exact-quantile search into the same pass."""
    aggs = []
    for c in cols:
        v = _value(df, c)
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.stddev_pop(v).alias(f"{c}__stdp"),
                 F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
        if with_splits:
            aggs.append(level0_splits(q(c)).alias(f"{c}__splits"))
    row = df.agg(*aggs).first().asDict()
    stats = ("count", "mean", "std", "stdp", "min", "max") + (("splits",) if with_splits else ())
    return {c: {s: row[f"{c}__{s}"] for s in stats} for c in cols}


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """pandas ``describe`` for numeric columns as long rows
    (column, stat, value): count, mean, std, min, percentiles, max."""
    cols = list(cols or numeric_columns(df))
    m = numeric_moments(df, cols, with_splits=True)
    qs = exact_quantiles(df, cols, percentiles, counts={c: int(m[c]["count"]) for c in cols},
                         initial_splits={c: m[c]["splits"] for c in cols})
    rows = []
    for c in cols:
        rows += [(c, "count", float(m[c]["count"])), (c, "mean", m[c]["mean"]), (c, "std", m[c]["std"]),
                 (c, "min", _f(m[c]["min"]))]
        rows += [(c, _pct_name(p), v) for p, v in zip(percentiles, qs[c])]
        rows.append((c, "max", _f(m[c]["max"])))
    schema = "column_name string, stat string, value double"
    return df.sparkSession.createDataFrame(rows, schema)


def _f(v):
    return None if v is None else float(v)


def _pct_name(p: float) -> str:
    s = f"{p * 100:.10g}"
    return f"p{s}"


def describe_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top (most frequent; smallest value on ties), freq per
    string column, from one unpivot + group."""
    cols = list(cols or string_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).alias("value"))
                                         for c in cols])).alias("x")).select("x.*")
    per_value = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def missing_counts(df: DataFrame, fraction: bool = True, hide_zero: bool = True) -> DataFrame:
    """Nulls (and NaN for floating columns) per column, descending; one
    aggregate pass, the fraction computed inside the same one-row result."""
    def isnull(f):
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return c.isNull() | F.isnan(c)
        return c.isNull()
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(isnull(f)).alias(f"m{i}") for i, f in enumerate(fields)])
    items = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("n_missing"),
                      (F.col(f"m{i}") / F.col("__n")).alias("fraction")) for i, f in enumerate(fields)]
    out = row.select(F.inline(F.array(*items)))
    if not fraction:
        out = out.drop("fraction")
    if hide_zero:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.desc("n_missing"), "column_name")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Label share, most frequent first; the total comes from a window over
    the (small) grouped result, not over the data."""
    from pyspark.sql import Window
    g = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
            .orderBy(F.desc("n"), "label"))


def win_loss_summary(df: DataFrame, label: str, win=1, loss=0) -> DataFrame:
    c = q(label)
    return df.agg(F.count_if(c == win).alias("wins"), F.count_if(c == loss).alias("losses"),
                  F.count(F.lit(1)).alias("total")).withColumn("win_ratio", F.col("wins") / F.col("total"))


def class_entropy_log_loss(df: DataFrame, label: str, multi: int = 10_000) -> DataFrame:
    """Log loss of always predicting the class shares.

    Shares are rounded to 4 places, the residual is added to the least
    frequent class, each class contributes floor(share * multi) samples;
    the closed form replaces materialising ``multi`` rows."""
    bal = class_balance(df, label).collect()  # one row per class (bounded)
    shares = [round(r["share"], 4) for r in bal]
    if shares and sum(shares) != 1.0:
        shares[-1] += 1 - sum(shares)
    ns = [int(s * multi) for s in shares]
    total = sum(ns)
    ll = -sum(n / total * math.log(s) for n, s in zip(ns, shares) if n)
    return df.sparkSession.createDataFrame([(len(shares), float(ll))], "n_classes int, log_loss double")


def few_valued(df: DataFrame, cols: Sequence[str], max_distinct: int) -> list[str]:
    """Of ``cols`` those that may hold at most ``max_distinct`` values, from
    one pass of distinct-count sketches, which are bounded and merge before
    anything is shuffled. d values fill at most d of a sketch's registers, so
    its estimate stays near d however they hash: a column is ruled out only
    far above the limit, and the rest are counted exactly."""
    row = df.agg(*[F.approx_count_distinct(q(c), 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"d{i}"] <= 2 * max_distinct + 10]


def unique_value_counts(df: DataFrame, cols: Sequence[str] | None = None, max_distinct: int = 20,
                        null_token: str = "_None_") -> DataFrame:
    """Value counts for string columns with at most ``max_distinct`` values,
    nulls reported as ``null_token`` (a row apart from that text as a value).
    Values of columns with many more never leave their task."""
    cols = few_valued(df, list(cols or string_columns(df)), max_distinct)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  q(c).alias("value"))
                                         for c in cols])).alias("x")).select("x.*")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # distinct non-null values per column, from the grouped (small) result
    nd = (counts.where(F.col("value").isNotNull()).groupBy("column_name")
          .agg(F.count(F.lit(1)).alias("nd")).where(F.col("nd") <= max_distinct).select("column_name"))
    return counts.join(nd, "column_name").withColumn("value", F.coalesce("value", F.lit(null_token)))


def nunique_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or string_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).alias("value"))
                                         for c in cols])).alias("x")).select("x.*")
    per = long.where(F.col("value").isNotNull()).select("column_name", "value").distinct()
    return per.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique")).orderBy("n_unique", "column_name")


def top_variance_columns(df: DataFrame, n: int, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    long = _unpivot_row(df, [(c, "std", F.stddev_samp(q(c))) for c in cols])
    return long.select("column_name", F.col("value").alias("std")).orderBy(F.desc("std"), "column_name").limit(n)


def zscore_extremes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most negative and most positive z-score per column (population std);
    null for a constant column."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for c in cols:
        sd = F.nullif(F.stddev_pop(q(c)), F.lit(0.0))
        aggs += [((F.min(q(c)) - F.avg(q(c))) / sd).alias(f"{c}__zmin"), ((F.max(q(c)) - F.avg(q(c))) / sd).alias(f"{c}__zmax")]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__zmin").alias("z_min"),
                             F.col(f"{c}__zmax").alias("z_max")) for c in cols])
    return row.select(F.inline(arr))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_outlier_counts(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - k*IQR, Q3 + k*IQR] per column and their share."""
    cols = list(cols or numeric_columns(df))
    b = iqr_bounds(df, cols, k)
    pairs = [(c, "n_outliers", F.count_if((q(c) < F.lit(lo)) | (q(c) > F.lit(hi)))) for c, (lo, hi) in b.items()]
    pairs.append(("__rows__", "n_rows", F.count(F.lit(1))))
    row = df.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(pairs)]).first()
    total = row[f"v{len(pairs) - 1}"]
    rows = [(c, float(lo), float(hi), int(row[f"v{i}"]), 100.0 * row[f"v{i}"] / total if total else None)
            for i, (c, (lo, hi)) in enumerate(b.items())]
    return (df.sparkSession.createDataFrame(
        rows, "column_name string, lower double, upper double, n_outliers long, pct_outliers double")
        .orderBy(F.desc("n_outliers"), "column_name"))


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; null if
    either is constant there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


#: Rows in which a value of each column is looked for; sums are taken around it.
SHIFT_ROWS = 1000
GRAM = ("n", "sx", "sy", "sxx", "syy", "sxy")


def gram_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for every pair of columns j <= i: sums
    over the rows where both are present (NaN and infinities count as missing), each column
    shifted by one of its values so that squares do not swamp the spread.

    One scan for any width: a task multiplies its batches as matrices (values
    and presence masks) and gives one row for each pair, and the sums of tasks
    merge by addition in a grouped aggregate."""
    k = len(cols)
    numbers = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = numbers.limit(SHIFT_ROWS).agg(*[F.first(F.when(F.abs(f"c{i}") < math.inf, F.col(f"c{i}")), ignorenulls=True).alias(f"c{i}") for i in range(k)]).first()
    shift = [0.0 if v is None else v for v in first]
    lower = np.tril_indices(k)

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            here = np.isfinite(x)
            x = np.where(here, x - shift, 0.0)
            m = here.astype(float)
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(lower[0], pa.int32()), pa.array(lower[1], pa.int32()), *(pa.array(s[lower]) for s in total)],
                                             names=["i", "j", *GRAM])

    parts = numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{g} double" for g in GRAM))
    return parts.groupBy("i", "j").agg(*[F.sum(g).alias(g) for g in GRAM])


def correlation_pairs(df: DataFrame, cols: Sequence[str], lower_with_diagonal: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlations as long rows (col_a, col_b,
    corr), from one scan (``gram_sums``); null if either column is constant
    where both are present, or if they never are."""
    names = F.array(*[F.lit(c) for c in cols])
    n = F.nullif(F.col("n"), F.lit(0.0))
    mx, my = F.col("sx") / n, F.col("sy") / n
    vx, vy = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my
    # what is left of the squares is rounding where a column is constant
    spread = lambda v, square: F.when(v > F.lit(1e-13) * square / n, v)
    corr = (F.col("sxy") / n - mx * my) / F.sqrt(spread(vx, F.col("sxx")) * spread(vy, F.col("syy")))
    found = gram_sums(df, cols)
    if not lower_with_diagonal:
        found = found.where(F.col("j") < F.col("i"))
    # every pair is a row, also of a table without rows
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + lower_with_diagonal)]
    every = df.sparkSession.createDataFrame(pairs, "i int, j int")
    return every.join(found, ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"),
        F.when(corr > 1.0, 1.0).when(corr < -1.0, -1.0).otherwise(corr).alias("corr"))


def leakage_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    c = correlation_pairs(df, cols, lower_with_diagonal=False)
    return c.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc_nulls_last("abs_corr"), "col_a", "col_b")


def feature_target_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    long = _unpivot_row(df, [(c, "corr", _corr(q(c), q(target))) for c in cols])
    return (long.select(F.col("column_name").alias("feature"), F.col("value").alias("corr"))
            .withColumn("abs_corr", F.abs("corr")).orderBy(F.desc_nulls_last("abs_corr"), "feature"))


def top_correlated_features(df: DataFrame, target: str, n: int, cols=None) -> DataFrame:
    return feature_target_corr(df, target, cols).limit(n)


def drop_low_corr_features(df: DataFrame, target: str, threshold: float, cols=None) -> DataFrame:
    """Keep features with |corr with target| >= threshold (target kept)."""
    fc = feature_target_corr(df, target, cols).collect()  # one row per feature
    keep = [r["feature"] for r in fc if r["abs_corr"] is not None and r["abs_corr"] >= threshold]
    if not keep:
        raise ValueError(f"no feature reaches |corr| >= {threshold} with {target}")
    return df.select(*[q(c) for c in sorted(keep)], q(target))


def cumulative_bins(df: DataFrame, col: str, step: float = 0.25) -> DataFrame:
    """Right edges min+step, min+2*step, ... up to max+step: rows <= edge
    (percent of all rows, 2 places) and the share of the value range the edge covers.

    A row is counted in the first edge that holds it, whose number follows
    from its distance to the minimum; counts per edge are then summed along
    the edges across partitions, so neither rows nor edges pass the driver.
    A table without values has no edges; a constant column has one, whose
    share of the range is null."""
    m = df.agg(F.min(q(col)).alias("mn"), F.max(q(col)).alias("mx"), F.count(F.lit(1)).alias("n")).first()
    spark = df.sparkSession
    if m["mn"] is None:
        return spark.createDataFrame([], "k int, bin_right double, n_le long, pct_rows double, pct_range double")
    mn, rng, n = float(m["mn"]), float(m["mx"]) - float(m["mn"]), m["n"]
    edge = lambda k: F.lit(mn) + (k + 1) * F.lit(float(step))
    x = q(col).cast("double")
    guess = F.greatest(F.ceil((x - F.lit(mn)) / F.lit(float(step))) - 1, F.lit(0))
    k = F.when(x > edge(guess), guess + 1).when((guess > 0) & (x <= edge(guess - 1)), guess - 1).otherwise(guess)
    counts = df.where(q(col).isNotNull()).groupBy(k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    edges = spark.range(int(rng / step) + 2).select(F.col("id").alias("k")).where(edge(F.col("k")) <= F.lit(float(m["mx"]) + step))
    run = prefix_sums(edges.join(counts, "k", "left").fillna(0, ["c"]), [F.col("k")], ["c"])
    right = edge(F.col("k"))
    return run.select(F.col("k").cast("int").alias("k"), right.alias("bin_right"), F.col("c_cum").alias("n_le"),
                      F.round(F.col("c_cum") / F.lit(n) * 100.0, 2).alias("pct_rows"),
                      (F.lit(100.0) * F.abs(right - F.lit(mn)) / F.nullif(F.lit(rng), F.lit(0.0))).alias("pct_range"))


def histogram_by_label(df: DataFrame, col: str, label: str, bins: int = 20) -> DataFrame:
    """Rows per equal-width bin and label; no rows for a column without values."""
    m = df.agg(F.min(q(col)).alias("mn"), F.max(q(col)).alias("mx")).first()
    mn, mx = (0.0, 0.0) if m["mn"] is None else (m["mn"], m["mx"])
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((q(col) - F.lit(mn)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.where(q(col).isNotNull()).groupBy(b.alias("bin"), q(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_left", F.lit(mn) + F.col("bin") * F.lit(width)))


def row_change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step and the percent change (two counts)."""
    nb = before.count()
    na = after.count()
    pct = (na - nb) * 100.0 / nb if nb else None
    return before.sparkSession.createDataFrame([(nb, na, pct)],
                                               "rows_before long, rows_after long, pct_change double")


# The spellings accepted as each type by infer_types.
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
TIMESTAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
BOOL_VALUES = ("true", "false")


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """For text columns: how many non-null values read as integer, float,
    timestamp and boolean, and the narrowest type that holds them all."""
    cols = list(cols or string_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(q(c))
        aggs += [F.count(q(c)).alias(f"n{i}"), F.count_if(v.rlike(INT_PATTERN)).alias(f"i{i}"),
                 F.count_if(v.rlike(FLOAT_PATTERN)).alias(f"f{i}"),
                 F.count_if(v.rlike(TIMESTAMP_PATTERN)).alias(f"t{i}"),
                 F.count_if(F.lower(v).isin(*BOOL_VALUES)).alias(f"b{i}")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"i{i}").alias("n_bigint"),
                      F.col(f"f{i}").alias("n_double"), F.col(f"t{i}").alias("n_timestamp"),
                      F.col(f"b{i}").alias("n_boolean")) for i, c in enumerate(cols)]
    wide = row.select(F.inline(F.array(*items)))
    n = F.col("n")
    return wide.withColumn(
        "inferred",
        F.when(n == 0, "empty").when(F.col("n_boolean") == n, "boolean").when(F.col("n_bigint") == n, "bigint")
        .when(F.col("n_double") == n, "double").when(F.col("n_timestamp") == n, "timestamp").otherwise("string"))


def schema_counts(df: DataFrame) -> DataFrame:
    """Data type -> number of columns (from the schema, no data pass)."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_columns int")
