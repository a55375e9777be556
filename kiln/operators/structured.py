"""Structured text columns: JSON objects and delimited composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.strings import split_part_or_null


def json_to_columns(df: DataFrame, col: str, schema: T.StructType, defaults: Mapping[str, object],
                    discover: bool = True, strict: bool = True, drop_source: bool = True) -> DataFrame:
    """Expand a JSON object column into columns.

    Known keys are parsed with an explicit schema (malformed JSON raises when
    ``strict``) and missing values take ``defaults``. With ``discover``, keys
    outside the schema are found with one distinct pass over the object keys
    and added as string columns, so there are as many as the result has
    columns (for keys without bound use ``json_long``); a key that is already a column's name gets the suffix ``_json``."""
    opts = {"mode": "FAILFAST"} if strict else {}
    # Parse once per row: the struct goes through a one-element ``inline``
    # (a generator), so neither field extraction nor later filters on the
    # fields can copy the parser into several expressions.
    parsed = F.from_json(F.col(col), schema, opts).alias("__json")
    df = df.select("*", F.inline(F.array(F.struct(parsed))))
    field = F.col("__json")
    out = {f.name: (F.coalesce(field[f.name], F.lit(defaults[f.name]).cast(f.dataType))
                    if defaults.get(f.name) is not None else field[f.name]) for f in schema.fields}
    if discover:
        known = {f.name for f in schema.fields}
        keys = df.select(F.explode(F.json_object_keys(F.col(col))).alias("k")).distinct().collect()
        taken = {c.lower() for c in df.columns} | {k.lower() for k in known}
        whole = F.from_json(F.col(col), "map<string,string>").alias("__keys")
        found = sorted(r["k"] for r in keys if r["k"] not in known)
        if found:
            df = df.select("*", F.inline(F.array(F.struct(whole))))
        for k in found:
            name = k
            while name.lower() in taken:
                name += "_json"
            taken.add(name.lower())
            out[name] = F.col("__keys")[k]
    res = df.withColumns(out).drop("__json", "__keys")
    return res.drop(col) if drop_source else res


def json_long(df: DataFrame, key: str, col: str, strict: bool = True) -> DataFrame:
    """A JSON object column as rows (key, name, value): one for each member,
    values as text (nested ones as JSON), null members as null. Names are data
    here, so there may be any number of them and none reaches the driver;
    null cells give no rows, and malformed JSON raises when ``strict``."""
    opts = {"mode": "FAILFAST"} if strict else {}
    members = F.from_json(F.col(f"`{col}`"), "map<string,string>", opts)
    return df.select(F.col(f"`{key}`"), F.explode(members).alias("name", "value"))


def split_composite(df: DataFrame, col: str, names: Sequence[str], sep: str = "|",
                    strict: bool = False, drop_source: bool = True) -> DataFrame:
    """``a|b|c`` -> one column per name; '' and missing parts become null."""
    out = {n: split_part_or_null(col, i, sep, parts=len(names), strict=strict) for i, n in enumerate(names)}
    res = df.withColumns(out)
    return res.drop(col) if drop_source else res
