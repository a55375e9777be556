"""Small helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.sources.tables import Tables

ROUND = 6  # doubles are compared at 6 decimals against the oracle


def tables(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def rounded(df: DataFrame, places: int = ROUND) -> DataFrame:
    """Round every float/double column for a value-hash comparison."""
    cols = {f.name: F.round(F.col(f"`{f.name}`"), places) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df
