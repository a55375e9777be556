"""Row hashes and order-free table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions._col import as_col

__all__ = ["sha256_of", "md5_bigint", "row_text", "table_fingerprint", "table_fingerprint_md5"]


def sha256_of(c) -> Column:
    """Hex SHA-256 of a string or binary column (file content, record text)."""
    return F.sha2(as_col(c), 256)


def md5_bigint(c, hex_digits: int = 15) -> Column:
    """First ``hex_digits`` hex digits of md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(as_col(c)), 1, hex_digits), 16, 10).cast("long")


def row_text(cols) -> Column:
    """Canonical text of a row: fields joined by U+001F, null as '\\N'."""
    return F.concat_ws("\u001f", *[F.coalesce(as_col(c).cast("string"), F.lit("\\N")) for c in cols])


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count plus bit_xor / sum of xxhash64 over
    canonical row text (a null and its column count)."""
    h = F.xxhash64(row_text(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.bit_xor(h).alias("xor_hash"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def table_fingerprint_md5(df: DataFrame, cols=None) -> DataFrame:
    """Portable variant: bit_xor and sum of md5-derived longs over canonical
    row text. The sum tells apart tables whose repeated rows cancel in the xor."""
    cols = cols or df.columns
    h = md5_bigint(row_text(cols))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))
