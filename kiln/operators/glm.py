"""Generalized linear models over factors: sum-to-zero contrasts, interactions
and a chi-square test for each term.

A model whose variables are all factors depends on its rows through the cells
of those factors alone: the count, the sum of the response and of its square
in each. Cells are one grouped aggregate with map-side combination, and every
fit then runs on as many weighted rows as there are cells, whatever the size
of the data. With numeric covariates the rows themselves are fitted.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.models import assembler
from kiln.operators.stats import chisq_sf

#: The link of each family.
LINKS = {"binomial": "logit", "gamma": "log"}


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each factor, from one grouped pass; each level but one
    is a design column, so they are few by the model's own nature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), q(f).cast("string").alias("v")) for f in factors])).alias("x"))
    found: dict[str, list] = {f: [] for f in factors}
    for r in long.select("x.*").where(F.col("v").isNotNull()).distinct().collect():
        found[r["f"]].append(r["v"])
    return {f: sorted(v) for f, v in found.items()}


def contrasts(factor: str, levels: Sequence[str]) -> list[Column]:
    """Sum-to-zero coding: one column for each level but the last, 1 where the
    row has that level, -1 where it has the last one, else 0."""
    value = q(factor).cast("string")
    return [F.when(value == level, 1.0).when(value == levels[-1], -1.0).otherwise(0.0) for level in levels[:-1]]


def design(terms: Sequence[Sequence[str]], levels: dict[str, list]) -> dict[tuple[str, ...], list[Column]]:
    """The columns of each term: a factor's contrasts, and for an interaction
    the products of its factors' contrasts."""
    out = {}
    for term in terms:
        columns = []
        for parts in itertools.product(*[contrasts(f, levels[f]) for f in term]):
            product = parts[0]
            for p in parts[1:]:
                product = product * p
            columns.append(product)
        out[tuple(term)] = columns
    return out


def _cells(df: DataFrame, label: str, factors: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """(factors, covariates, y, w, yy): mean response, rows and sum of squares."""
    y = q(label).cast("double")
    whole = df.where(y.isNotNull())
    for c in [*factors, *covariates]:
        whole = whole.where(q(c).isNotNull())
    if covariates:
        return whole.select(*[q(f) for f in factors], *[q(c).cast("double").alias(c) for c in covariates], y.alias("y"), F.lit(1.0).alias("w"), (y * y).alias("yy"))
    return whole.groupBy(*[q(f) for f in factors]).agg(F.avg(y).alias("y"), F.count(y).cast("double").alias("w"), F.sum(y * y).alias("yy"))


class Fit:
    """One fitted model: coefficients, deviance and the information matrix."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], family: str):
        est = GeneralizedLinearRegression(labelCol="y", weightCol="w", family=family, link=LINKS[family], maxIter=50, tol=1e-10)
        placed = assembler(columns).transform(rows) if columns else None
        if placed is None:  # the intercept alone: one constant column would be singular beside it
            total = rows.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
            self.mean = total[0] / total[1]
            scored = rows.withColumn("mu", F.lit(self.mean))
        else:
            model = est.fit(placed)
            self.coefficients = np.array([model.intercept, *model.coefficients])
            scored = model.transform(placed).withColumnRenamed("prediction", "mu")
        w, y, mu = F.col("w"), F.col("y"), F.col("mu")
        safe = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
        if family == "binomial":
            deviance, weight = 2 * w * (safe(y, mu) + safe(1 - y, 1 - mu)), w * mu * (1 - mu)
            pearson = w * (y - mu) * (y - mu) / (mu * (1 - mu))
        else:
            deviance, weight = 2 * w * (-F.log(y / mu) + (y - mu) / mu), w
            # with the spread inside a cell, which its mean does not show
            pearson = (F.col("yy") - 2 * mu * w * y + w * mu * mu) / (mu * mu)
        x = [F.lit(1.0), *[F.col(f"`{c}`") for c in columns]]
        pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
        r = scored.agg(F.sum(deviance).alias("d"), F.sum(pearson).alias("p"), F.sum(w).alias("n"),
                       *[F.sum(weight * x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs]).first()
        self.deviance, self.n = r["d"], r["n"]
        self.dispersion = 1.0 if family == "binomial" else r["p"] / (self.n - len(x))
        self.information = np.zeros((len(x), len(x)))
        for i, j in pairs:
            self.information[i, j] = self.information[j, i] = r[f"x{i}_{j}"]


def factor_tests(df: DataFrame, label: str, terms: Sequence[Sequence[str]], family: str, covariates: Sequence[str] = ()) -> DataFrame:
    """(term, df, lr_chisq, lr_p, wald_chisq, wald_p) for every term of a
    model with sum-coded factors, each against all the others (type III).

    The likelihood-ratio statistic compares the deviance of the nested fit
    without the term's columns to the whole fit's (divided by the dispersion
    for the gamma family); Wald's takes the term's coefficients and their block
    of the covariance. Rows with a null in the response, a factor or a
    covariate are left out. A combination of an interaction's levels that no
    row has cannot be fitted and raises, as does a factor of one level."""
    factors = sorted({f for t in terms for f in t})
    held = rows = _cells(df, label, factors, covariates).cache()
    try:
        levels = factor_levels(rows, factors)
        for f, v in levels.items():
            if len(v) < 2:
                raise ValueError(f"factor {f!r} has {len(v)} level(s)")
        seen = {tuple(map(str, r)) for r in rows.select(*[q(f) for f in factors]).distinct().collect()}
        for t in terms:
            at = [factors.index(f) for f in t]
            missing = set(itertools.product(*[levels[f] for f in t])) - {tuple(c[i] for i in at) for c in seen}
            if missing:
                raise ValueError(f"no rows for {':'.join(t)} = {sorted(missing)[0]}")
        columns, names = design(terms, levels), {}
        for k, (term, made) in enumerate(columns.items()):
            names[term] = [f"__t{k}_{i}" for i in range(len(made))]
            rows = rows.withColumns(dict(zip(names[term], made)))
        every = [c for t in names.values() for c in t] + list(covariates)
        whole = Fit(rows, every, family)
        covariance = np.linalg.inv(whole.information) * whole.dispersion
        out = []
        for term, mine in names.items():
            at = [1 + every.index(c) for c in mine]
            b = whole.coefficients[at]
            wald = float(b @ np.linalg.solve(covariance[np.ix_(at, at)], b))
            nested = Fit(rows, [c for c in every if c not in mine], family)
            lr = max((nested.deviance - whole.deviance) / whole.dispersion, 0.0)
            out.append((":".join(term), len(mine), lr, chisq_sf(lr, len(mine)), wald, chisq_sf(wald, len(mine))))
    finally:
        held.unpersist()
    return df.sparkSession.createDataFrame(out, "term string, df int, lr_chisq double, lr_p double, wald_chisq double, wald_p double")
