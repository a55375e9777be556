"""Experiment statistics as grouped aggregations.

Sums of squares, cell means, ranks and KS distances are Spark aggregates;
only the handful of resulting numbers reach the driver, where the
distribution tails (F, t, normal, exact Kolmogorov) are evaluated.

Ranks inside a group (Holm steps, KS order statistics, presentation
position) come from ``family_rank``: an exact global index over
(family, order) minus each family's first position, so no group is ever
sorted whole inside one task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.sampling import global_index
from kiln.sources.sinks import snapshot

# ---------------------------------------------------------------- ranks


def _c(n):
    return F.col(n if n.startswith("`") else f"`{n}`")


def family_rank(df: DataFrame, family: Sequence[str], order: Sequence[str], rank_col: str = "rank",
                size_col: str = "family_size", keep_partition: bool = False) -> DataFrame:
    """1-based position of each row inside its family in ``order`` order,
    plus the family size."""
    gi = global_index(df, list(family) + list(order), "__pos", keep_partition=keep_partition)
    fam = gi.groupBy(*[_c(f) for f in family]).agg(F.min("__pos").alias("__start"),
                                                   F.count(F.lit(1)).alias(size_col))
    cond = None
    for f in family:
        c = gi[f].eqNullSafe(fam[f])
        cond = c if cond is None else cond & c
    j = gi.join(fam, cond).drop(*[fam[f] for f in family])
    return j.withColumn(rank_col, F.col("__pos") - F.col("__start") + 1).drop("__start")


def holm_adjust(df: DataFrame, p_col: str, family: Sequence[str], key: Sequence[str],
                out: str = "p_holm") -> DataFrame:
    """Holm step-down: ascending rank i of m in a family, p*(m-i+1), running
    maximum, capped at 1. The running maximum is prefix-combined across
    range partitions (one small row per partition and family)."""
    r = family_rank(df, family, [p_col] + list(key), "__i", "__m", keep_partition=True)
    r = r.withColumn("__raw", (F.col("__m") - F.col("__i") + 1) * _c(p_col))
    fam_cols = [_c(f) for f in family]
    part_max = r.groupBy(*fam_cols, "__pid").agg(F.max("__raw").alias("__pmax"))
    w_prev = Window.partitionBy(*fam_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    prefix = part_max.withColumn("__before", F.max("__pmax").over(w_prev)).drop("__pmax")
    cond = None
    for f in family:
        c = r[f].eqNullSafe(prefix[f])
        cond = c if cond is None else cond & c
    cond = cond & (r["__pid"] == prefix["__pid"])
    j = r.join(prefix, cond).drop(*[prefix[f] for f in family]).drop(prefix["__pid"])
    w_local = Window.partitionBy("__pid", *fam_cols).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.greatest(F.coalesce(F.col("__before"), F.lit(0.0)), F.max("__raw").over(w_local))
    return (j.withColumn(out, F.least(F.lit(1.0), run))
            .drop("__i", "__m", "__raw", "__before", "__pid", "__pos"))


# ------------------------------------------------------------ distributions

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta function (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if f is None or f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def norm_sf2(z: float) -> float:
    """Two-sided normal tail P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chisq_sf(x: float, df: int) -> float:
    """P(X > x) for the chi-square distribution: the upper incomplete gamma
    function, by its series below the mean and its continued fraction above."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h


def kolmogorov_exact_p(n: int, d: float) -> float:
    """Exact two-sided one-sample KS p-value P(D_n >= d) (Marsaglia, Tsang
    and Wang 2003, matrix-power form)."""
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    H = np.zeros((m, m))
    for i in range(m):
        for j in range(m):
            if i - j + 1 >= 0:
                H[i, j] = 1.0
    for i in range(m):
        H[i, 0] -= h ** (i + 1)
        H[m - 1, i] -= h ** (m - i)
    H[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0.0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                for g in range(1, i - j + 2):
                    H[i, j] /= g
    eH = 0
    Q = np.identity(m)
    power = n
    base = H.copy()
    eB = 0
    while power:
        if power & 1:
            Q = Q @ base
            eH += eB
            if Q[k - 1, k - 1] > 1e140:
                Q *= 1e-140
                eH += 140
        base = base @ base
        eB *= 2
        if base[k - 1, k - 1] > 1e140:
            base *= 1e-140
            eB += 140
        power >>= 1
    s = Q[k - 1, k - 1]
    for i in range(1, n + 1):
        s = s * i / n
        if s < 1e-140:
            s *= 1e140
            eH -= 140
    return float(max(0.0, min(1.0, 1.0 - s * 10.0 ** eH)))


# --------------------------------------------------------- KS, counterbalance

def ks_exponential(df: DataFrame, group: str, value: str, key: Sequence[str]) -> DataFrame:
    """Per group: rate = 1/mean and the KS distance D of the sample from
    Exp(rate), D = max(i/n - F(x_i), F(x_i) - (i-1)/n)."""
    means = df.groupBy(_c(group)).agg(F.avg(_c(value)).alias("__mean"))
    r = family_rank(df.select(group, value, *key), [group], [value] + list(key), "__i", "__n")
    r = r.join(means, r[group].eqNullSafe(means[group])).drop(means[group])
    cdf = 1 - F.exp(-_c(value) / F.col("__mean"))
    dev = F.greatest(F.col("__i") / F.col("__n") - cdf, cdf - (F.col("__i") - 1) / F.col("__n"))
    return (r.groupBy(_c(group)).agg(F.first("__n").alias("n"), (1 / F.first("__mean")).alias("rate"),
                                     F.max(dev).alias("d")))


def kolmogorov_limit_p(n: str, d: str, terms: int = 100):
    """P(D_n >= d) by Kolmogorov's limit, the caller's choice for large n
    (``kolmogorov_exact_p`` is for samples whose n * d is some hundreds)."""
    x = F.lit(-2.0) * F.col(n) * F.col(d) * F.col(d)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(x * k * k))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))


#: Samples up to this size get the exact Kolmogorov p-value (its matrices have
#: about 2 n d rows); larger ones the limit, which is then within a thousandth.
EXACT_KS = 1000


def with_kolmogorov_p(df: DataFrame, n: str = "n", d: str = "d", exact_up_to: int = EXACT_KS) -> DataFrame:
    """``df`` (one row a sample) with ``p``, P(D_n >= d), and ``exact``,
    whether it is the exact one; null where ``n`` or ``d`` is null."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

    def run(batches):
        for batch in batches:
            ns, ds = batch.column("n").to_pylist(), batch.column("d").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("d"), pa.array(
                [kolmogorov_exact_p(a, b) for a, b in zip(ns, ds)], pa.float64())], names=["n", "d", "p"])

    # equal (n, d) have equal p: each is worked out once
    asked = df.where(F.col(n) <= exact_up_to).select(F.col(n).cast("long").alias("n"), F.col(d).cast("double").alias("d")).where("n > 0 AND d IS NOT NULL")
    found = asked.distinct().mapInArrow(run, "n long, d double, p double").select(F.col("n").alias("__n"), F.col("d").alias("__d"), F.col("p").alias("__p"))
    j = df.join(found, (F.col(n) == F.col("__n")) & (F.col(d) == F.col("__d")), "left")
    exact = F.col("__p").isNotNull()
    return j.select(*[F.col(f"`{c}`") for c in df.columns], F.when(exact, F.col("__p")).otherwise(kolmogorov_limit_p(n, d)).alias("p"),
                    F.when(F.col(n).isNotNull() & F.col(d).isNotNull(), exact).alias("exact"))


def counterbalance(df: DataFrame, subject: str, condition: str, order):
    """Position x condition counts and (predecessor, condition) counts;
    balanced when every cell of each table holds the same count. ``order``
    is a column or a list of columns (add a key to break ties)."""
    order = [order] if isinstance(order, str) else list(order)
    r = family_rank(df.select(subject, condition, *order), [subject], order, "position", "__n").drop("__n")
    pos = r.groupBy("position", _c(condition).alias("condition")).agg(F.count(F.lit(1)).alias("n"))
    prev = r.select(_c(subject).alias("__s"), (F.col("position") + 1).alias("__p"),
                    _c(condition).alias("previous"))
    pairs = (r.join(prev, (r[subject] == prev["__s"]) & (r["position"] == prev["__p"]))
             .groupBy("previous", _c(condition).alias("condition")).agg(F.count(F.lit(1)).alias("n")))
    return pos, pairs


# ------------------------------------------------------ repeated measures


def _cell_table(df, response, subject, factors):
    return df.groupBy(_c(subject), *[_c(f) for f in factors]).agg(F.avg(_c(response)).alias("__y"))


def _sums_of_squares(df: DataFrame, response: str, subject: str, factors: Sequence[str],
                     sets: Sequence[Sequence[str]]) -> tuple[int, dict[tuple, tuple[float, int]]]:
    """(number of cells, {set: (sum of squares of its means about the grand
    mean, number of levels)}); the set of all keys gives the total. The cells
    are computed once, and one aggregate over grouping sets serves every set."""
    keys = [subject, *factors]
    cells = snapshot(_cell_table(df, response, subject, factors), "cells")
    total = cells.agg(F.avg("__y").alias("g"), F.count(F.lit(1)).alias("n")).first()
    wanted = [tuple(s) for s in sets] + [tuple(keys)]
    means = cells.groupingSets([[_c(k) for k in s] for s in wanted], *[_c(k) for k in keys]).agg(
        F.grouping_id().alias("__set"), F.avg("__y").alias("m"), F.count(F.lit(1)).alias("w"))
    rows = means.groupBy("__set").agg(F.sum(F.col("w") * (F.col("m") - F.lit(total["g"])) ** 2).alias("ss"),
                                      F.count(F.lit(1)).alias("levels")).collect()
    by = {r["__set"]: (r["ss"], r["levels"]) for r in rows}
    code = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    return total["n"], {s: by[code(s)] for s in wanted}


def rm_anova_oneway(df: DataFrame, response: str, factor: str, subject: str) -> dict:
    """Random-intercept one-way repeated-measures F test (balanced data).

    When the subject variance estimate is not positive the model is at its
    boundary: subject and error sums of squares are pooled into the error
    mean square, df2 kept."""
    N, ss = _sums_of_squares(df, response, subject, [factor], [[factor], [subject]])
    (ss_a, k), (ss_s, n), (tot, _) = ss[(factor,)], ss[(subject,)], ss[(subject, factor)]
    ss_e = tot - ss_a - ss_s
    df1, df2 = k - 1, (n - 1) * (k - 1)
    ms_e, ms_s = ss_e / df2, ss_s / (n - 1)
    pooled = ms_s <= ms_e
    ms_err = (ss_s + ss_e) / ((n - 1) + df2) if pooled else ms_e
    f = (ss_a / df1) / ms_err
    return {"n_subjects": n, "n_levels": k, "n_obs": N, "ss_factor": ss_a, "ss_subject": ss_s, "ss_error": ss_e,
            "df1": df1, "df2": df2, "ms_error": ms_err, "pooled": pooled, "f": f, "p": f_sf(f, df1, df2)}


def rm_anova_twoway(df: DataFrame, response: str, a: str, b: str, subject: str) -> list[dict]:
    """Two within-subject factors and their interaction, one random
    intercept, df2 = (n-1)(ab-1); same boundary pooling rule."""
    _, ss = _sums_of_squares(df, response, subject, [a, b], [[a], [b], [a, b], [subject]])
    (ss_a, la), (ss_b, lb), (ss_ab_cells, _) = ss[(a,)], ss[(b,)], ss[(a, b)]
    (ss_s, n), (tot, _) = ss[(subject,)], ss[(subject, a, b)]
    ss_ab = ss_ab_cells - ss_a - ss_b
    ss_e = tot - ss_a - ss_b - ss_ab - ss_s
    df_e = (n - 1) * (la * lb - 1)
    ms_e, ms_s = ss_e / df_e, ss_s / (n - 1)
    pooled = ms_s <= ms_e
    ms_err = (ss_s + ss_e) / ((n - 1) + df_e) if pooled else ms_e
    out = []
    for name, ss, d1 in [(a, ss_a, la - 1), (b, ss_b, lb - 1), (f"{a}:{b}", ss_ab, (la - 1) * (lb - 1))]:
        f = (ss / d1) / ms_err
        out.append({"effect": name, "ss": ss, "df1": d1, "df2": df_e, "ss_error": ss_e, "ss_subject": ss_s,
                    "ms_error": ms_err, "pooled": pooled, "f": f, "p": f_sf(f, d1, df_e)})
    return out


def pairwise_z(df: DataFrame, response: str, factor: str, subject: str, ms_error: float) -> list[dict]:
    """All level pairs: difference of level means, SE = sqrt(2 MS / n),
    z and two-sided normal p (level means come from one aggregate)."""
    cells = _cell_table(df, response, subject, [factor])
    lv = sorted(cells.groupBy(_c(factor)).agg(F.avg("__y").alias("m"), F.count(F.lit(1)).alias("n"))
                .collect(), key=lambda r: str(r[0]))
    out = []
    for i in range(len(lv)):
        for j in range(i + 1, len(lv)):
            diff = lv[i]["m"] - lv[j]["m"]
            se = math.sqrt(2 * ms_error / lv[i]["n"])
            z = diff / se
            out.append({"level_a": lv[i][0], "level_b": lv[j][0], "diff": diff, "se": se, "z": z,
                        "p": norm_sf2(z)})
    return out


def holm_list(ps: Sequence[float]) -> list[float]:
    """Holm on a short in-memory list (for per-model contrasts)."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    m = len(ps)
    adj = [0.0] * m
    run = 0.0
    for rank, i in enumerate(order, start=1):
        run = max(run, (m - rank + 1) * ps[i])
        adj[i] = min(1.0, run)
    return adj
