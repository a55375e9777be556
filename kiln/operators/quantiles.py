"""Exact order statistics without gathering a column into one task.

Spark's exact ``percentile`` merges a value->count map of the whole column
in a single task, which does not survive a large table. Here an exact
order statistic is found by narrowing:

1. ``percentile_approx`` proposes up to ``buckets - 1`` split points inside
   the current value window (one pass, all windows at once);
2. every row in a window gets the number of its bucket from Spark ML's
   ``Bucketizer`` (a binary search in the JVM) and the rows are counted per
   (window, bucket) with partial aggregation (one pass, only bucket counts
   are shuffled);
3. a rank that falls on a bucket's first or last row is that bucket's min or
   max, and a bucket whose min equals its max resolves all its ranks (a hot
   value needs no more work); otherwise the bucket is the next window.

Each level cuts the window by ~``buckets``, and the driver only ever holds
bucket counts and bounds. Values are compared as doubles.
"""

from __future__ import annotations

import math

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_window(v: Column, lo, hi) -> Column:
    cond = v.isNotNull() & ~F.isnan(v)
    if lo is not None:
        cond = cond & (v >= F.lit(lo))
    if hi is not None:
        cond = cond & (v <= F.lit(hi))
    return cond


def level0_splits(c: Column, buckets: int = 256) -> Column:
    """The first level's split proposal for a column, as an aggregate that a
    caller can fold into its own one-pass ``agg`` (see ``initial_splits``)."""
    v = F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("double"))
    return F.percentile_approx(v, [j / buckets for j in range(1, buckets)], 8 * buckets)


def order_statistics(df: DataFrame, wanted: dict[str, Iterable[int]], buckets: int = 256,
                     initial_splits: dict[str, list] | None = None) -> dict[str, dict[int, float]]:
    """Exact k-th smallest values (0-based ranks over non-null, non-NaN
    values) for several columns: ``{col: {rank: value}}``. ``initial_splits``
    (from ``level0_splits``), when the caller already has them, save a pass."""
    # window: (col, lo, hi, offset) -> ranks wanted inside it (absolute ranks)
    windows: dict[tuple, set[int]] = {}
    for c, ranks in wanted.items():
        rs = set(ranks)
        if rs:
            windows[(c, None, None, 0)] = rs
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wanted])
    while windows:
        large = list(windows)
        nxt: dict[tuple, set[int]] = {}
        nb = max(2, buckets)
        qs = [j / nb for j in range(1, nb)]
        given = {i: initial_splits[c] for i, (c, lo, hi, off) in enumerate(large)
                 if lo is None and hi is None and initial_splits and initial_splits.get(c)}
        todo = [(i, k) for i, k in enumerate(large) if i not in given]
        approx = dict(given)
        if todo:
            row = src.agg(*[F.percentile_approx(F.when(_in_window(F.col(c), lo, hi), F.col(c)), qs, 8 * nb)
                            .alias(f"w{i}") for i, (c, lo, hi, off) in todo]).first()
            approx.update({i: row[f"w{i}"] for i, _ in todo})
        approx = {f"w{i}": v for i, v in approx.items()}
        splits = []
        for i, (c, lo, hi, off) in enumerate(large):
            sp = set(approx[f"w{i}"])
            if lo is not None and hi is not None:
                sp.add(lo + (hi - lo) / 2.0)  # guarantees the value range halves
            sp = {x for x in sp if math.isfinite(x)}
            splits.append([-math.inf] + sorted(sp) + [math.inf])
        # bucket numbers from Spark ML's Bucketizer (binary search in the
        # JVM); rows outside a window are null there and get no bucket
        ins = {f"__x{i}": F.when(_in_window(F.col(c), lo, hi), F.col(c)) for i, (c, lo, hi, off) in
               enumerate(large)}
        bucketed = Bucketizer(splitsArray=splits, inputCols=list(ins), handleInvalid="keep",
                              outputCols=[f"__b{i}" for i in range(len(large))]).transform(src.withColumns(ins))
        # the window minimum gets a bucket of its own, so a window
        # dominated by one value always makes progress
        items = F.array(*[
            F.struct(F.lit(i).alias("w"),
                     (F.col(f"__b{i}").cast("int") if lo is None else
                      F.when(F.col(f"__x{i}") == F.lit(lo), F.lit(-1)).otherwise(F.col(f"__b{i}").cast("int")))
                     .alias("b"),
                     F.col(f"__x{i}").alias("v"))
            for i, (c, lo, hi, off) in enumerate(large)])
        hits = (bucketed.select(F.explode(items).alias("x")).select("x.w", "x.b", "x.v")
                .where(F.col("v").isNotNull()))
        stats = (hits.groupBy("w", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                             F.max("v").alias("hi")).collect())
        by_w: dict[int, list] = {}
        for r in stats:
            by_w.setdefault(r["w"], []).append(r)
        for i, k in enumerate(large):
            c, lo, hi, off = k
            rows = sorted(by_w.get(i, []), key=lambda r: r["b"])
            start = off
            for r in rows:
                end = start + r["n"]
                hit = [rank for rank in windows[k] if start <= rank < end]
                if hit:
                    for rank in hit:
                        if rank == start or r["lo"] == r["hi"]:
                            out[c][rank] = r["lo"]
                        elif rank == end - 1:
                            out[c][rank] = r["hi"]
                        else:
                            nxt.setdefault((c, r["lo"], r["hi"], start), set()).add(rank)
                start = end
        windows = nxt
    return out


def linear_ranks(n: int, p: float) -> tuple[int, int, float]:
    """pandas 'linear' quantile: position (n-1)p split into floor/ceil/frac."""
    h = (n - 1) * p
    lo = math.floor(h)
    return lo, min(lo + 1, n - 1), h - lo


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    counts: dict[str, int] | None = None, **kw) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column (nulls and NaN skipped);
    extra keyword arguments go to ``order_statistics``."""
    if counts is None:
        # one pass: the counts and the first level's split proposals together
        aggs = []
        for c in cols:
            aggs += [F.count_if(_in_window(F.col(f"`{c}`").cast("double"), None, None)).alias(f"{c}__n"),
                     level0_splits(F.col(f"`{c}`"), kw.get("buckets", 256)).alias(f"{c}__s")]
        row = df.agg(*aggs).first()
        counts = {c: row[f"{c}__n"] for c in cols}
        kw.setdefault("initial_splits", {c: row[f"{c}__s"] for c in cols})
    wanted = {}
    for c in cols:
        n = counts[c]
        if n:
            wanted[c] = {r for p in probs for r in linear_ranks(n, p)[:2]}
    stats = order_statistics(df, wanted, **kw)
    out: dict[str, list] = {}
    for c in cols:
        n = counts[c]
        res = []
        for p in probs:
            if not n:
                res.append(None)
                continue
            lo, hi, frac = linear_ranks(n, p)
            a, b = stats[c][lo], stats[c][hi]
            res.append(a + (b - a) * frac if frac else a)
        out[c] = res
    return out
