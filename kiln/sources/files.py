"""Readers: delimited text, pipe-delimited connection logs, multi-file
concatenation, paged JSON listings and file inventories.

Schemas are always explicit (no inference pass over the data); column
pruning reaches the scan because only listed columns are selected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",",
                   header: bool = True, null_value: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def read_conn_log(spark: SparkSession, glob: str, schema: T.StructType | str,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Many (possibly gzip) files, '|' separated, '-' meaning null, only the
    listed columns (dotted names are quoted)."""
    df = read_delimited(spark, glob, schema, sep="|", header=True, null_value="-")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def concat_files(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """One DataFrame over every listed path (rows stacked, no index); all
    files must have the same columns."""
    return spark.read.format(fmt).options(**options).load(list(paths))


#: Whole-number types from narrow to wide, and their decimal digits.
_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_DIGITS = [3, 5, 10, 19]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: whole numbers, then decimals or
    doubles, dates in timestamps; anything else meets as text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[max(_WHOLE.index(a), _WHOLE.index(b))]
    fraction = (T.FloatType, T.DoubleType)
    if all(isinstance(x, T.NumericType) for x in (a, b)):
        if any(isinstance(x, fraction) for x in (a, b)):
            return T.DoubleType()
        parts = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (_DIGITS[_WHOLE.index(x)], 0) for x in (a, b)]
        digits, scale = max(p[0] for p in parts), max(p[1] for p in parts)
        return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of frames whose columns differ: columns meet by name, in the order
    in which they first come up; one that a frame lacks is null there, and
    types that differ are widened."""
    kinds: dict[str, T.DataType] = {}
    for f in (f for df in frames for f in df.schema.fields):
        kinds[f.name] = wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out = None
    for df in frames:
        mine = set(df.columns)
        part = df.select(*[(F.col(f"`{c}`") if c in mine else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        out = part if out is None else out.union(part)
    return out


def concat_mixed_files(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """One DataFrame over paths whose columns differ (``concat_frames``). Each
    path, a file, folder or glob, is read with the schema of its own; files
    under one path share theirs."""
    return concat_frames([spark.read.format(fmt).options(**options).load(p) for p in paths])


def read_json_listing(spark: SparkSession, path: str, schema: T.StructType | str, fields: Sequence[str],
                      children: str = "data.children", multi_line: bool = False) -> DataFrame:
    """Paged listing files -> one row per child ``data`` object with the
    chosen fields. A page is one line, or, with ``multi_line``, one file
    (pretty-printed, or an array of pages). Text that is not such JSON raises."""
    pages = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
    kids = pages.select(F.explode(F.col(children)).alias("child"))
    return kids.select(*[F.col(f"child.data.{f}").alias(f) for f in fields])


def read_file_inventory(spark: SparkSession, root: str, glob: str = "*", with_hash: bool = True) -> DataFrame:
    """Recursive listing: path, modification time, size (+ SHA-256)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).load(root))
    cols = [F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    if with_hash:
        cols.append(F.sha2(F.col("content"), 256).alias("sha256"))
    return df.select(*cols)
