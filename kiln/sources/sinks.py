"""Writers: prepared CSV, gzip training CSV, run history, table snapshots.

Every writer targets a folder (a directory of part files), never a single
local file, so executors write in parallel and a lost task is simply rerun.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kiln.session import scratch_path


def derived_name(path: str, suffix: str = "prepped") -> str:
    """``data/sales.csv`` -> ``data/sales_prepped.csv`` (folder of parts)."""
    stem, dot, ext = path.rpartition(".")
    if not dot or "/" in ext:
        return f"{path}_{suffix}"
    return f"{stem}_{suffix}.{ext}"


def write_prepared_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_training_csv_gz(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    (df.write.mode(mode).option("header", True).option("quoteAll", True)
     .option("compression", "gzip").option("encoding", "UTF-8").csv(path))
    return path


def append_run_history(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """Append metric rows in a fixed column order, all values as strings."""
    out = df.select(*[df[c].cast("string").alias(c) for c in columns])
    out.write.mode("append").option("header", True).csv(path)
    return path


def read_run_history(spark, path: str, columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder of the shared checkpoint folder and
    read back: later stages restart from its files. Against ``checkpoint`` the
    rows are computed once, and readers skip columns they do not use. A column
    of no type at all cannot be written and makes it a checkpoint."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def snapshot_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Persist a query result as the catalog table ``name`` (drop if exists,
    create) and return the table; any later query reads it by name, and a
    second run replaces it. The rows are written before the old table goes,
    each time to a folder of their own (``path``, or one in the shared
    checkpoint folder), so the result may be derived from the table itself."""
    spark = df.sparkSession
    location = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(location)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return spark.catalog.createTable(name, path=location, source="parquet")
