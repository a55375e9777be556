"""CRM opportunity preparation, step by step as ``df.transform`` calls that
build one lazy plan. Actions happen only where a fitted constant is needed
(one-hot levels, the class count for exact upsampling)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kiln.functions.strings import first_token
from kiln.operators import prep as P
from kiln.operators import relational as O
from kiln.operators import sampling as SM
from kiln.operators import structured as ST
from kiln.sources.sinks import snapshot

LABEL = "Won"

# The preparation constants of the opportunity model.
WINSOR_MIN = {"Age of opp in days": 30, "Deal size (USD)": 10000, "Num times opp pushed": 0,
              "quarter_created": 1, "quarter_closed": 1}
WINSOR_MAX = {"Age of opp in days": 365, "Deal size (USD)": 180000, "Num times opp pushed": 6,
              "quarter_created": 4, "quarter_closed": 4}
FIXED_RANGE_COLUMNS = ["Age of opp in days", "Deal size (USD)", "Num times opp pushed", "quarter_created",
                       "quarter_closed"]
DROP_BELOW = {"quarter_created": 1, "quarter_closed": 1, "Age of opp in days": 14, "Deal size (USD)": 1500}
DROP_ABOVE = {"quarter_created": 4, "quarter_closed": 4, "Age of opp in days": 720, "Deal size (USD)": 1000000}
DTYPES = {"Industry": "string", "Sales Rep ID": "string", "Sales team name": "string",
          "primary_product": "string", "Num times opp pushed": "uint8", "quarter_created": "uint8",
          "quarter_closed": "uint8", "Age of opp in days": "uint16", LABEL: "bool",
          "partner_involved": "bool", "Deal size (USD)": "uint32"}
ONE_HOT = ["Industry", "Sales Rep ID", "Sales team name", "positioning_category", "product_family",
           "hosting_location", "sales_territory"]
MANDATORY = ["Sales Rep ID", "Sales team name", "Age of opp in days", LABEL, "Deal size (USD)"]
UNUSED = ["CRM Identifier"]
FORMULA_SCHEMA = T.StructType([T.StructField("quarter_created", T.IntegerType()),
                               T.StructField("quarter_closed", T.IntegerType()),
                               T.StructField("primary_product", T.StringType()),
                               T.StructField("partner_involved", T.BooleanType())])


def json_features(df: DataFrame) -> DataFrame:
    return ST.json_to_columns(df, "array_of_sfdc_formulas", FORMULA_SCHEMA,
                              {"quarter_created": 0, "quarter_closed": 0}, discover=False)


def set_types(df: DataFrame) -> DataFrame:
    return O.cast_schema(df, DTYPES)


def drop_unused(df: DataFrame) -> DataFrame:
    return O.drop_columns(df, UNUSED)


def product_features(df: DataFrame) -> DataFrame:
    return ST.split_composite(df, "primary_product", ["positioning_category", "product_family", "hosting_location"])


def territory(df: DataFrame) -> DataFrame:
    return df.withColumn("sales_territory", first_token("`Sales team name`"))


def in_ranges(df: DataFrame) -> DataFrame:
    return O.drop_rows_outside_ranges(df, {c: (DROP_BELOW.get(c), DROP_ABOVE.get(c))
                                           for c in set(DROP_BELOW) | set(DROP_ABOVE)})


def mandatory(df: DataFrame) -> DataFrame:
    return O.drop_rows_missing(df, MANDATORY)


def winsorize(df: DataFrame) -> DataFrame:
    return P.winsorize_columns(df, WINSOR_MIN, WINSOR_MAX)


def fixed_range(df: DataFrame) -> DataFrame:
    return P.minmax_fixed(df, {c: (WINSOR_MIN[c], WINSOR_MAX[c]) for c in FIXED_RANGE_COLUMNS})


def encode(df: DataFrame, levels=None) -> DataFrame:
    return P.one_hot_columns(df, ONE_HOT, levels=levels)


def clean_load(df: DataFrame) -> DataFrame:
    """Read + the first six steps (the clean, typed, unscaled table)."""
    return (df.transform(json_features).transform(set_types).transform(drop_unused)
            .transform(product_features).transform(territory).transform(in_ranges))


def prepare(df: DataFrame, levels=None) -> DataFrame:
    """All steps up to (not including) resampling. Unless the one-hot levels
    are given, the cleaned rows are written once, so that finding the levels
    does not read, join and parse the source a second time."""
    clean = df.transform(clean_load).transform(mandatory).transform(winsorize).transform(fixed_range)
    if levels is None:
        clean = snapshot(clean, "sales-clean")
    return clean.transform(lambda d: encode(d, levels)).transform(O.bools_to_ints)


def prepare_for_training(df: DataFrame, seed=123456, order_cols=None, prepared=None) -> DataFrame:
    """The whole chain: prepare -> upsample wins by 1.6 -> trainability check.
    ``prepared`` is applied to the prepared rows before they are resampled."""
    prepped = prepare(df)
    prepped = prepared(prepped) if prepared else prepped
    up = SM.upsample_class(prepped, LABEL, positive=1, factor=1.6, seed=seed, order_cols=order_cols or prepped.columns)
    return P.assert_trainable(up)
