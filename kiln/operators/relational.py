"""Projection, filters, casts, joins and set operations.

Everything here is a lazy DataFrame transformation. The one exception,
``drop_empty_columns``, needs one aggregate pass to learn which columns are
empty; it returns a single bounded row (one count per column).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions._col import as_col

# ---------------------------------------------------------------- projection


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose every value is null (one aggregate pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric (not boolean) column names, sorted."""
    ex = set(exclude)
    return sorted(f.name for f in df.schema.fields if _is_numeric(f.dataType) and f.name not in ex)


def select_numeric(df: DataFrame, label: str | None = None, keep_label: bool = True) -> DataFrame:
    """Numeric columns in name order; the label (if any) last or dropped."""
    cols = numeric_columns(df, exclude=[label] if label else [])
    if label and keep_label:
        cols.append(label)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by dict; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def reorder_label_last(df: DataFrame, label: str) -> DataFrame:
    cols = sorted(c for c in df.columns if c != label) + [label]
    return df.select(*[F.col(f"`{c}`") for c in cols])


# Numpy-style dtype names and the Spark type plus value range
# each maps to (Spark has no unsigned integers, so ranges are asserted).
DTYPE_MAP = {
    "uint8": ("smallint", 0, 255), "uint16": ("int", 0, 65535),
    "uint32": ("bigint", 0, 4294967295), "uint64": ("bigint", 0, None),
    "int8": ("tinyint", None, None), "int16": ("smallint", None, None),
    "int32": ("int", None, None), "int64": ("bigint", None, None),
    "float32": ("float", None, None), "float64": ("double", None, None),
    "bool": ("boolean", None, None), "category": ("string", None, None),
    "string": ("string", None, None),
}


def cast_column(c, dtype: str) -> Column:
    """Cast to the Spark type for ``dtype``; values outside an unsigned
    range raise instead of wrapping."""
    c = as_col(c)
    spark_type, lo, hi = DTYPE_MAP.get(dtype, (dtype, None, None))
    if lo is None and hi is None:
        return c.cast(spark_type)
    bad = c < lo if hi is None else ~c.between(lo, hi)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"value out of range for {dtype}: "),
                                              c.cast("string")))).otherwise(c.cast(spark_type))


def cast_schema(df: DataFrame, dtypes: Mapping[str, str],
                flags_to_int: Iterable[str] = ()) -> DataFrame:
    """Cast by a dtype dict, then turn the listed boolean flags into 0/1."""
    out = {c: cast_column(f"`{c}`", t) for c, t in dtypes.items() if c in df.columns}
    for c in flags_to_int:
        src = out.get(c, F.col(f"`{c}`"))
        out[c] = src.cast("boolean").cast("tinyint")
    return df.withColumns(out)


def bools_to_ints(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("tinyint") for c in cols})


# ------------------------------------------------------------------- filters

_CMP = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def filter_compare(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """SQL comparison filter; null never matches."""
    return df.where(_CMP[op](F.col(col), F.lit(value)))


def filter_like(df: DataFrame, col: str, pattern: str, case_insensitive: bool = False,
                negate: bool = False) -> DataFrame:
    c = F.col(col)
    cond = c.ilike(pattern) if case_insensitive else c.like(pattern)
    return df.where(~cond if negate else cond)


def filter_regex(df: DataFrame, col: str, pattern: str, negate: bool = False) -> DataFrame:
    cond = F.col(col).rlike(pattern)
    return df.where(~cond if negate else cond)


def label_not_in(c, negatives: Iterable[str] = ("Benign",)) -> Column:
    """True unless the value is one of ``negatives``; null counts as True."""
    return ~F.coalesce(as_col(c).isin(list(negatives)), F.lit(False))


def label_in(c, positives: Iterable[str]) -> Column:
    """True only for the listed values; null counts as False."""
    return F.coalesce(as_col(c).isin(list(positives)), F.lit(False))


def drop_rows_outside_ranges(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Drop rows with a value below its low or above its high bound.

    Bounds are inclusive and a null value is kept (its comparison is not
    true, so the row is not dropped). ``None`` as a bound means open.
    """
    cond = F.lit(True)
    for col, (lo, hi) in ranges.items():
        c = F.col(f"`{col}`")
        out = F.lit(False)
        if lo is not None:
            out = out | (c < lo)
        if hi is not None:
            out = out | (c > hi)
        cond = cond & ~F.coalesce(out, F.lit(False))
    return df.where(cond)


def drop_rows_missing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows null (or NaN) in any listed column."""
    return df.na.drop(how="any", subset=list(cols))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def add_column_default_then_update(df: DataFrame, name: str, predicate: Column,
                                   value: Column, default=None) -> DataFrame:
    """ALTER TABLE ADD COLUMN ... DEFAULT d; UPDATE ... SET = v WHERE p."""
    return df.withColumn(name, F.when(F.coalesce(predicate, F.lit(False)), value)
                         .otherwise(F.lit(default)))


def sort_rows(df: DataFrame, keys: Iterable, ascending: bool | Iterable[bool] = True) -> DataFrame:
    """Sort with nulls last in both directions (pandas order)."""
    keys = list(keys)
    asc = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
    order = [(as_col(k).asc_nulls_last() if a else as_col(k).desc_nulls_last())
             for k, a in zip(keys, asc)]
    return df.orderBy(*order)


def head_rows(df: DataFrame, n: int, keys: Iterable, ascending=True) -> DataFrame:
    """First ``n`` rows after a sort; a sort key is required for determinism."""
    return sort_rows(df, keys, ascending).limit(n)


# --------------------------------------------------------------------- joins



def anti_join_missing(expected: DataFrame, observed: DataFrame, key: str,
                      observed_key: str | None = None, case_insensitive: bool = True) -> DataFrame:
    """Expected rows whose key has no match in ``observed``."""
    ok = observed_key or key
    norm = (lambda c: F.lower(F.trim(c))) if case_insensitive else (lambda c: c)
    obs = observed.select(norm(F.col(ok)).alias("__k")).where(F.col("__k").isNotNull())
    return (expected.withColumn("__k", norm(F.col(key)))
            .join(obs, "__k", "left_anti").drop("__k"))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def distinct_sorted(df: DataFrame, col: str, descending: bool = True) -> DataFrame:
    c = F.col(col)
    return df.select(c).distinct().orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
