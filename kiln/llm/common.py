"""Table access, worker shipping and scratch tables shared by the operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import scratch_path

_SHIPPED: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that
    functions pickled by reference can be imported on any executor. Spark
    serves the archive from the driver; it is a few hundred kilobytes."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(os.path.join(root, "kiln")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="kiln-ship-"), "kiln_llm_package.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a later stage then
    starts from files any executor can read, and the planner knows their size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(row, rf, rn): every row as a struct of all its columns, under a number
    that any later pass over the frame finds again. Rows that come straight
    from files have one: the file (a 64-bit hash of its path) and the place in
    it. Others are written once with theirs."""
    if "_metadata" not in df.columns:
        try:
            return df.select(whole_row(df).alias("row"), F.xxhash64("_metadata.file_path").alias("rf"), F.col("_metadata.row_index").alias("rn"))
        except AnalysisException:  # not rows of files, or not of files that number their rows
            pass
    return stored(df.select(whole_row(df).alias("row"), F.lit(0).cast("long").alias("rf"), F.monotonically_increasing_id().alias("rn")), name)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no column's name meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Tables of at most so many short fixed-width rows are broadcast in joins with texts.
BROADCAST_ROWS = 400_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table whose counted rows are few; otherwise let the
    join shuffle. The count reads file footers only."""
    return F.broadcast(df) if df.count() <= rows else df
