"""Connection-log preparation for the malware classifier.

``fit`` makes the aggregate passes once (one-hot levels; order statistics
for winsorizing; moments for standardising) and ``apply`` is a pure
projection with those constants, so the same preparation runs on a batch
table or on a stream of arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.net import port_range
from kiln.functions.timefn import epoch_to_hour, shift_hour
from kiln.operators import prep as P
from kiln.operators import profile as PR
from kiln.operators import relational as O
from kiln.operators import sampling as SM
from kiln.operators.quantiles import level0_splits, order_statistics
from kiln.sources.sinks import snapshot

LABEL = "is_IoT_malware"

# Imputation, clipping and scaling choices of the log preparation.
FILL_ZERO = ["duration", "orig_bytes", "resp_bytes", "missed_bytes", "resp_ip_bytes", "resp_pkts", "orig_pkts",
             "orig_ip_bytes"]
WINSOR_THEN_ZSCORE = ["duration", "orig_pkts", "orig_ip_bytes"]
WINSOR_LIMITS = (0.05, 0.05)
CLIP_UPPER = {"missed_bytes": 25000, "resp_pkts": 100, "resp_ip_bytes": 7500}
ZSCORE = ["orig_bytes", "resp_bytes", "missed_bytes", "resp_pkts", "resp_ip_bytes"]
HOUR_SHIFT = -18
CORR_THRESHOLD = 0.04
DROP = ["uid", "id.orig_h", "id.resp_h", "tunnel_parents"]
ONE_HOT = ["service", "proto"]


def _base(conn: DataFrame) -> DataFrame:
    df = O.fill_missing(conn, {c: 0 for c in FILL_ZERO})
    df = df.withColumn(LABEL, O.label_not_in("label", ["Benign"])).drop("label")
    df = df.withColumn("hour_of_day", shift_hour(epoch_to_hour("ts"), HOUR_SHIFT)).drop("ts")
    df = P.minmax_fixed(df, {"hour_of_day": (0, 23)})
    df = df.withColumn("src_port_range_name", port_range("`id.orig_p`").cast("tinyint")).drop("id.orig_p")
    return df.drop(*DROP)


def fit(conn: DataFrame) -> dict:
    """The constants of the preparation; an empty log has no bounds and no scale."""
    base = _base(conn)
    levels = P.one_hot_levels(base, ONE_HOT)
    # one pass for the counts and the quantile search's first split points
    row = base.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(WINSOR_THEN_ZSCORE)],
                   *[level0_splits(F.col(c)).alias(f"s{i}") for i, c in enumerate(WINSOR_THEN_ZSCORE)]).first()
    n = {c: row[f"n{i}"] for i, c in enumerate(WINSOR_THEN_ZSCORE) if row[f"n{i}"]}
    splits = {c: row[f"s{i}"] for i, c in enumerate(WINSOR_THEN_ZSCORE)}
    lo_rank = {c: int(WINSOR_LIMITS[0] * n[c]) for c in n}
    hi_rank = {c: n[c] - int(WINSOR_LIMITS[1] * n[c]) - 1 for c in n}
    stats = order_statistics(base, {c: {lo_rank[c], hi_rank[c]} for c in n}, initial_splits=splits) if n else {}
    bounds = {c: (stats[c][lo_rank[c]], stats[c][hi_rank[c]]) for c in n}
    w = base.withColumns({c: P.clip_high(P.clip_low(c, lo), hi) for c, (lo, hi) in bounds.items()}) if bounds else base
    # clipping touches none of the winsorized columns, so one moments pass
    # over the clipped frame serves both standardisations
    m = P.moments(P.clip_upper(w, CLIP_UPPER), WINSOR_THEN_ZSCORE + ZSCORE)
    scale = {c: (m[c][0], m[c][2]) for c in WINSOR_THEN_ZSCORE + ZSCORE}
    return {"levels": levels, "bounds": bounds, "scale": scale}


def apply(conn: DataFrame, consts: dict) -> DataFrame:
    """Projection only: usable on a streaming DataFrame. A column that was
    constant when the constants were fitted is 0 there and where it still has
    that value: its distance to the mean, unscaled."""
    df = _base(conn)
    df = P.one_hot_columns(df, ONE_HOT, levels=consts["levels"])
    if consts["bounds"]:
        df = df.withColumns({c: P.clip_high(P.clip_low(c, lo), hi) for c, (lo, hi) in consts["bounds"].items()})
    df = P.clip_upper(df, CLIP_UPPER)
    df = df.withColumns({c: (F.col(c) - F.lit(mu or 0.0)) / F.lit(sd or 1.0) for c, (mu, sd) in consts["scale"].items()})
    return O.bools_to_ints(df)


def prepare(conn: DataFrame) -> DataFrame:
    """Up to (not including) feature selection and shuffling."""
    return apply(conn, fit(conn))


def prepare_for_training(conn: DataFrame, seed=123456, key_name: str | None = None) -> DataFrame:
    """The whole chain: prepare -> features that correlate with the label ->
    trainability check -> seeded shuffle. The prepared table is written once;
    selection, check and shuffle read it from there. ``key_name`` keeps the
    number that the rows are shuffled by."""
    df = snapshot(prepare(conn), "conn-prepared")
    df = PR.drop_low_corr_features(df, LABEL, CORR_THRESHOLD)
    df = P.assert_trainable(df)
    return SM.shuffle_rows(df, df.columns, seed, key_name)
