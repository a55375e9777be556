"""Feature preparation: clipping, winsorizing, scaling, one-hot encoding,
trainability checks.

Fitted constants (bounds, moments, levels) come from one aggregate pass and
are applied as literals in a single projection, so the transform stays a
narrow, codegen'd map over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.quantiles import level0_splits, order_statistics



def q(c: str) -> Column:
    return F.col(f"`{c}`")


def clip_low(c, lo) -> Column:
    """Values below ``lo`` become ``lo``; null stays null."""
    c = q(c) if isinstance(c, str) else c
    return F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)


def clip_high(c, hi) -> Column:
    c = q(c) if isinstance(c, str) else c
    return F.when(c > F.lit(hi), F.lit(hi)).otherwise(c)


def winsorize_low(df: DataFrame, col: str, lo) -> DataFrame:
    return df.withColumn(col, clip_low(col, lo))


def winsorize_high(df: DataFrame, col: str, hi) -> DataFrame:
    return df.withColumn(col, clip_high(col, hi))


def winsorize_columns(df: DataFrame, lows: Mapping[str, object], highs: Mapping[str, object]) -> DataFrame:
    """Both sides for every listed column in one projection."""
    out = {}
    for c in set(lows) | set(highs):
        if c not in df.columns:
            continue
        e = q(c)
        if c in lows:
            e = clip_low(e, lows[c])
        if c in highs:
            e = clip_high(e, highs[c])
        out[c] = e
    return df.withColumns(out)


def clip_upper(df: DataFrame, caps: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: clip_high(c, v) for c, v in caps.items()})


def minmax_fixed(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """(x - lo) / (hi - lo) with given constants; not clipped to [0, 1]."""
    return df.withColumns({c: (q(c) - F.lit(lo)) / F.lit(hi - lo) for c, (lo, hi) in ranges.items()})


def minmax_relative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) of the data; null where the range is 0."""
    r = df.agg(*[F.min(q(c)).alias(f"{c}__mn") for c in cols], *[F.max(q(c)).alias(f"{c}__mx") for c in cols]).first()
    out = {}
    for c in cols:
        mn, mx = r[f"{c}__mn"], r[f"{c}__mx"]
        out[c] = (q(c) - F.lit(mn)) / F.nullif(F.lit(mx) - F.lit(mn), F.lit(0)) if mn is not None else q(c)
    return df.withColumns(out)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    r = df.agg(*[F.avg(q(c)).alias(f"{c}__m") for c in cols],
               *[F.stddev_samp(q(c)).alias(f"{c}__s") for c in cols],
               *[F.stddev_pop(q(c)).alias(f"{c}__p") for c in cols],
               *[F.count_if(q(c).isNull()).alias(f"{c}__n") for c in cols]).first()
    return {c: (r[f"{c}__m"], r[f"{c}__s"], r[f"{c}__p"], r[f"{c}__n"]) for c in cols}


def _scaled(c: str, mean: float | None, std: float | None):
    if not std:
        return F.lit(None).cast("double")
    return (q(c) - F.lit(mean)) / F.lit(std)


def zscore_sample(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std with n - 1; null where the column is constant."""
    m = moments(df, cols)
    return df.withColumns({c: _scaled(c, m[c][0], m[c][1]) for c in cols})


def zscore_population(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std with n; a column holding any null becomes all null
    (the NaN-propagating rule), so fill first; a constant column too."""
    m = moments(df, cols)
    out = {}
    for c in cols:
        mean, _, std, nulls = m[c]
        out[c] = F.lit(None).cast("double") if nulls else _scaled(c, mean, std)
    return df.withColumns(out)


class PopulationScaler:
    """Fit mean / population std once, reuse the constants on other data."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.params: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> "PopulationScaler":
        m = moments(df, self.cols)
        self.params = {c: (m[c][0], m[c][2]) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (q(c) - F.lit(mu)) / F.lit(sd if sd else 1.0)
                               for c, (mu, sd) in self.params.items()})


def winsorize_percent(df: DataFrame, cols: Sequence[str], limits=(0.05, 0.05)) -> DataFrame:
    """Replace the lowest int(lo*n) and highest int(hi*n) values by the
    nearest kept order statistic (exact, via distributed order statistics)."""
    # one pass for the counts and the search's first split points
    row = df.agg(*[F.count_if(q(c).isNotNull() & ~F.isnan(q(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[level0_splits(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    ranks = {}
    for c in cols:
        n = counts[c]
        if n:
            ranks[c] = {int(limits[0] * n), n - int(limits[1] * n) - 1}
    stats = order_statistics(df, ranks, initial_splits={c: row[f"s{i}"] for i, c in enumerate(cols)})
    out = {}
    for c in cols:
        n = counts[c]
        if not n:
            continue
        lo = stats[c][int(limits[0] * n)]
        hi = stats[c][n - int(limits[1] * n) - 1]
        out[c] = clip_high(clip_low(c, lo), hi)
    return df.withColumns(out)


def one_hot_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Distinct non-null levels of several columns in one pass. They become
    column names, so they are as many as the wide result has columns; for a
    column of unbounded values use ``one_hot_long``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v"))
                                         for c in cols])).alias("x")).select("x.*")
    rows = long.where(F.col("v").isNotNull()).distinct().collect()
    levels: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        levels[r["c"]].append(r["v"])
    for vs in levels.values():
        vs.sort()
    return levels


def one_hot_long(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The encoding as rows (key, feature): one row for each non-null cell,
    ``<col>_<value>`` as in the wide form, with no level list on the driver."""
    cells = F.array(*[F.concat(F.lit(f"{c}_"), q(c).cast("string")) for c in cols])
    return df.select(q(key), F.explode(F.array_compact(cells)).alias("feature"))


def one_hot_columns(df: DataFrame, cols: Sequence[str], levels: Mapping[str, list] | None = None) -> DataFrame:
    """``<col>_<value>`` 0/1 columns (tinyint), value-sorted, no level
    dropped, null -> all 0; the source columns are dropped."""
    levels = levels or one_hot_levels(df, cols)
    keep = [q(c) for c in df.columns if c not in cols]
    flags = [F.coalesce((q(c).cast("string") == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))
             .alias(f"{c}_{v}") for c in cols for v in levels[c]]
    return df.select(*keep, *flags)


def one_hot(df: DataFrame, col: str, **kw) -> DataFrame:
    return one_hot_columns(df, [col], **kw)


def _numeric_or_bool(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def trainable_report(df: DataFrame) -> DataFrame:
    """Per column: type, null count, ready flag (numeric/boolean, no nulls)."""
    fields = df.schema.fields
    row = df.agg(*[F.count_if(q(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    items = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                      F.col(f"n{i}").alias("n_null"),
                      ((F.col(f"n{i}") == 0) & F.lit(_numeric_or_bool(f.dataType))).alias("ready"))
             for i, f in enumerate(fields)]
    return row.select(F.inline(F.array(*items)))


def assert_trainable(df: DataFrame) -> DataFrame:
    """Raise naming the first column that is not numeric/boolean or holds
    nulls; otherwise return ``df`` unchanged (one aggregate pass)."""
    for f in df.schema.fields:
        if not _numeric_or_bool(f.dataType):
            raise TypeError(f"column {f.name!r} has type {f.dataType.simpleString()}, not numeric")
    rep = trainable_report(df).where(~F.col("ready")).limit(1).collect()
    if rep:
        raise ValueError(f"column {rep[0]['column_name']!r} has {rep[0]['n_null']} nulls")
    return df
