"""Model training and scoring with Spark ML.

Every estimator is a Spark ML stage inside a Pipeline; the prepared frame
is persisted while cross-validation reuses it and unpersisted afterwards.
Fold assignment uses a hash of the row key (``foldCol``) so folds are
stable across runs and partitionings."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import (IDF, PCA, Bucketizer, HashingTF, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler,
                                VectorAssembler)
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.sampling import hash_unit


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


REGRESSORS = {
    "linear": lambda label, **kw: LinearRegression(labelCol=label, solver="normal", **kw),
    "tree": lambda label, **kw: DecisionTreeRegressor(labelCol=label, **kw),
    "forest": lambda label, **kw: RandomForestRegressor(labelCol=label, **kw),
    "gbt": lambda label, **kw: GBTRegressor(labelCol=label, **kw),
}


#: Rows that boosted trees and forests take one by one; more are grouped by their bins.
TREE_ROWS = 50_000
#: Bins of a feature (the learners' own default), and quantiles that they are laid by.
BINS, QUANTILES = 32, 1000
#: Grouped rows that a forest draws its samples from, about.
FOREST_GROUPS = 250_000
#: Groups that make a boosting task worth starting, while there are free cores.
GROUPS_A_TASK = 25_000
#: Parts of a bin that a forest draws by itself at most, and forests that are fitted at the same time.
BLOCKS, FORESTS = 256, 20


def thresholds(values: Sequence[tuple[float, float]], bins: int = BINS) -> list[float]:
    """Where a tree learner cuts a feature with these (value, count) pairs, in
    ascending order: between all values of a feature that has at most ``bins``,
    else where the running count is nearest to a multiple of its share."""
    halves = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:])]
    if len(values) <= bins:
        return halves
    stride = sum(n for _, n in values) / bins
    out, target, run = [], stride, values[0][1]
    for half, (_, n) in zip(halves, values[1:]):
        if abs(run - target) < abs(run + n - target):
            out.append(half)
            target += stride
        run += n
    return out


def feature_bins(rows: DataFrame, features: Sequence[str]) -> tuple[int, list[list[float]]]:
    """The number of rows and the thresholds of each feature, from all rows:
    every value of a feature with few, else ``QUANTILES`` quantiles."""
    cols = [F.col(c).cast("double") for c in features]
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)],
                   *[F.percentile_approx(c, shares, 10 * QUANTILES).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(cols)) if row[f"d{i}"] <= 2 * BINS]
    values = {i: [(v, 1) for v in row[f"q{i}"] or []] for i in range(len(cols))}
    if few:
        met = rows.agg(*[F.collect_set(cols[i]).alias(f"v{i}") for i in few]).first()
        values |= {i: [(v, 1) for v in sorted(met[f"v{i}"])] for i in few if len(met[f"v{i}"]) <= BINS}
    counted = [[(v, sum(n for _, n in g)) for v, g in itertools.groupby(values[i], key=lambda x: x[0])] for i in range(len(cols))]
    return row["n"], [thresholds(v) for v in counted]


def grouped_by_bins(rows: DataFrame, features: Sequence[str], label: str, apart: Sequence[Column] = ()) -> DataFrame:
    """One row per combination of the (binned) ``features`` and of ``apart``:
    its rows' mean label and, as ``weight``, their number. A tree cannot part
    rows of equal bins, and their squared errors about the mean are the same in
    every tree, so it grows on the groups as on the rows. A missing label makes
    its group's NaN, which the learner refuses."""
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))
    return (rows.groupBy(*[F.col(f) for f in features], *apart)
            .agg(F.avg(y).alias(label), F.count(F.lit(1)).cast("double").alias("weight")))


def forest_groups(rows: DataFrame, features: Sequence[str], label: str, n: int) -> DataFrame:
    """``grouped_by_bins`` for a learner that draws rows: bins of many rows are
    dealt into parts of about ``n`` / ``FOREST_GROUPS`` rows, ``BLOCKS`` at
    most, each of which is drawn for itself with its rows' own mean."""
    blocks = grouped_by_bins(rows, features, label, [F.pmod(F.xxhash64(*rows.columns), F.lit(BLOCKS)).alias("block")])
    in_bin = F.sum("weight").over(Window.partitionBy(*features))
    parts = F.ceil(in_bin * F.lit(FOREST_GROUPS / n)).cast("long")
    return (blocks.withColumn("part", F.col("block") % parts).groupBy(*features, "part")
            .agg((F.sum(F.col(label) * F.col("weight")) / F.sum("weight")).alias(label), F.sum("weight").alias("weight")))


def fit_forests(rows: DataFrame, est: RandomForestRegressor, pre: Sequence) -> PipelineModel:
    """A forest fitted as forests of some of its trees each, side by side, and
    their mean: a job then holds the nodes of a few trees, where one fit sends
    those of all trees from every partition."""
    n, sc = est.getNumTrees(), rows.sparkSession.sparkContext
    sizes = [n // min(n, FORESTS) + (i < n % min(n, FORESTS)) for i in range(min(n, FORESTS))]

    def one(task: tuple) -> object:
        i, size = task
        sc.setLocalProperty("spark.scheduler.pool", "forest")
        part = est.copy({est.numTrees: size, est.seed: est.getSeed() + i, est.predictionCol: f"forest_{i}"})
        return part.fit(rows)

    with ThreadPoolExecutor(max_workers=len(sizes)) as pool:
        models = list(pool.map(inheritable_thread_target(one), enumerate(sizes)))
    mean = " + ".join(f"{size} * forest_{i}" for i, size in enumerate(sizes))
    return PipelineModel([*pre, *models, SQLTransformer(statement=f"SELECT *, ({mean}) / {n} AS prediction FROM __THIS__")])


def fit_trees(df: DataFrame, est, features: Sequence[str], label: str) -> PipelineModel:
    """A boosted or bagged tree learner on all rows of ``df``. More than
    ``TREE_ROWS`` of them are binned by the learner's rule, grouped by their
    bins (classes apart) and weighted by their number: the passes, of which the
    learner makes hundreds, go over the groups."""
    rows = df.select(*features, F.col(label)).persist()
    try:
        if rows.count() <= TREE_ROWS:
            return Pipeline(stages=[assembler(features), est]).fit(df)
        n, cuts = feature_bins(rows, features)
        names = [f"bin_{i}" for i in range(len(features))]
        # a constant feature has one bin, beyond a cut of its own
        binned = Bucketizer(splitsArray=[[-math.inf, *(c or [0.0]), math.inf] for c in cuts], inputCols=list(features),
                            outputCols=names)
        pre = [binned, assembler(names)]
        bins = binned.transform(rows).select(*[F.col(b).cast("tinyint").alias(b) for b in names], label)
        forest = isinstance(est, RandomForestRegressor)
        classes = [F.col(label).alias("class")] if isinstance(est, GBTClassifier) else []
        groups = forest_groups(bins, names, label, n) if forest else grouped_by_bins(bins, names, label, classes)
        groups, held = groups.persist(), rows
        try:
            # a forest's partition sends the statistics of every node, so its tasks are few; forests run side by side
            tasks = math.ceil(groups.count() / (FOREST_GROUPS if forest else GROUPS_A_TASK))
            if not forest:
                tasks = max(min(tasks, df.sparkSession.sparkContext.defaultParallelism), math.ceil(tasks / 20))
            held = pre[1].transform(groups.coalesce(tasks)).select("features", label, "weight").persist()
            held.count()  # held before the fits ask for it
            est = est.copy({est.weightCol: "weight"})
            return fit_forests(held, est, pre) if forest else PipelineModel([*pre, est.fit(held)])
        finally:
            groups.unpersist()
            held.unpersist()
    finally:
        rows.unpersist()


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the model's prediction for each row. Where a model of
    ``fit_trees`` sees bins, each combination of bins is scored once and its
    rows take the result: hundreds of deep trees are slow to walk."""
    if not isinstance(model.stages[0], Bucketizer):
        return model.transform(df).select(*keep, "prediction")
    names = model.stages[0].getOutputCols()
    rows = model.stages[0].transform(df).select(*keep, *names)
    scored = PipelineModel(model.stages[1:]).transform(rows.select(*names).distinct()).select(*names, "prediction")
    return rows.join(scored, names).select(*keep, "prediction")


#: Regressors that pass over their rows for every level of every tree.
MANY_PASSES = ("forest", "gbt")


def fit_regressor(df: DataFrame, kind: str, features: Sequence[str], label: str, **params) -> PipelineModel:
    est = REGRESSORS[kind](label, **params)
    if kind in MANY_PASSES:
        return fit_trees(df, est, features, label)
    return Pipeline(stages=[assembler(features), est]).fit(df)


def fit_gbt_classifier(df: DataFrame, features: Sequence[str], label: str, max_depth=2, max_iter=100,
                       step_size=0.9, seed=123456) -> PipelineModel:
    est = GBTClassifier(labelCol=label, maxDepth=max_depth, maxIter=max_iter, stepSize=step_size, seed=seed)
    return fit_trees(df, est, features, label)


#: Hashed terms of the text classifier, and rows that it is fitted on at most.
TEXT_FEATURES, TEXT_ROWS = 8192, 50_000


def text_classifier(text_col: str, label: str, features: int = TEXT_FEATURES, hidden=(64, 32), max_iter=100,
                    step_size=0.01, seed=123456) -> Pipeline:
    """L2-normalised TF-IDF over ``features`` hashed terms into a dense network
    whose hidden layers halve in width and end in a two-way output. The model
    is ``features`` x 64 weights whatever the vocabulary of the corpus; no term
    list is built."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False,
                       toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
        MultilayerPerceptronClassifier(labelCol=label, layers=[features, *hidden, 2], maxIter=max_iter,
                                       stepSize=step_size, seed=seed, solver="gd"),
    ])


def fit_text_classifier(train: DataFrame, text_col: str, label: str, key: Sequence[str], max_rows: int = TEXT_ROWS, seed=123456,
                        **kw) -> PipelineModel:
    """``text_classifier`` fitted on about ``max_rows`` labelled rows at most
    (all of them where there are fewer), drawn by a hash of their key; the
    model is meant to score every row."""
    n = train.where(F.col(label).isNotNull()).count()
    sample = train.where(F.col(label).isNotNull())
    if n > max_rows:
        sample = sample.where(hash_unit(seed, *key) < F.lit(max_rows / n))
    return text_classifier(text_col, label, seed=seed, **kw).fit(sample)


def pca_fit(df: DataFrame, features: Sequence[str], k: int) -> PipelineModel:
    """Standardise (centre) then project on the top ``k`` components."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="scaled", outputCol="pca"),
    ]).fit(df)


def explained_variance(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[-1].explainedVariance.toArray()]


def with_folds(df: DataFrame, key: Sequence[str], k: int, seed=123456, col: str = "fold") -> DataFrame:
    return df.withColumn(col, F.floor(hash_unit(seed, *key) * k).cast("int"))


#: Fits that a search submits at the same time.
PARALLELISM = 4


def cross_validate(df: DataFrame, estimator, grid: Mapping, score, features: Sequence[str], key: Sequence[str],
                   folds: int = 5, pca_k: int | None = None, seed=123456, parallelism: int = PARALLELISM) -> list[dict]:
    """Every parameter set over stable folds, scored by every metric that
    ``score(scored frame)`` returns, on the held-out fold and on the training
    folds. One dict per set: params, fit_seconds, the frame's n_rows, and test
    and train as {metric: (mean, std)}. With ``pca_k`` the features are projected first.

    Fits of all sets and folds are independent: ``parallelism`` threads submit
    them over the one cached frame, in a scheduler pool of their own, so that
    small jobs fill the cluster together. The result does not depend on it."""
    pb = ParamGridBuilder()
    for param, values in grid.items():
        pb = pb.addGrid(getattr(estimator, param), list(values))
    pre = [assembler(features)] if not pca_k else [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=pca_k, inputCol="scaled", outputCol="features")]
    sets = pb.build()
    sc = df.sparkSession.sparkContext
    data = with_folds(df, key, folds, seed).persist()

    def one(task: tuple) -> tuple[float, dict, dict]:
        pm, k = task
        sc.setLocalProperty("spark.scheduler.pool", "grid-search")
        train = data.where(F.col("fold") != k)
        t0 = time.perf_counter()
        model = Pipeline(stages=[*pre, estimator.copy(pm)]).fit(train)
        seconds = time.perf_counter() - t0
        return seconds, score(model.transform(data.where(F.col("fold") == k))), score(model.transform(train))

    def spread(runs: Sequence[dict]) -> dict:
        both = {m: [r[m] for r in runs if r[m] is not None] for m in runs[0]}
        return {m: (float(np.mean(v)), float(np.std(v))) if v else (None, None) for m, v in both.items()}

    try:
        n_rows = data.count()  # cached before the threads ask for it
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            done = list(pool.map(inheritable_thread_target(one), [(pm, k) for pm in sets for k in range(folds)]))
    finally:
        data.unpersist()
    out = []
    for i, pm in enumerate(sets):
        seconds, held, seen = zip(*done[i * folds:(i + 1) * folds])
        out.append({"params": ";".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda x: x[0].name)),
                    "fit_seconds": sum(seconds) / len(seconds), "n_rows": n_rows, "test": spread(held), "train": spread(seen)})
    return out


#: Metrics of which less is better.
LESS = {"rmse", "brier_loss", "log_loss"}


def best_of(results: list[dict], metric: str) -> dict:
    sign = -1 if metric in LESS else 1
    return max((r for r in results if r["test"][metric][0] is not None), key=lambda r: sign * r["test"][metric][0])


def cv_table(spark, results: list[dict], metrics: Sequence[str]) -> DataFrame:
    rows = [(r["params"], m, *r["test"][m], *r["train"][m]) for r in results for m in metrics]
    return spark.createDataFrame(rows, "params string, metric string, mean_metric double, std_metric double, "
                                       "mean_train double, std_train double")


#: The fields of an experiment's history row, in their fixed order.
HISTORY = ("started_at", "metric", "test_size", "best_score", "best_params", "param_grid", "folds", "grid_seconds", "model_class",
           "seed", "scorer", "mean_fit_seconds", "x_hash", "y_hash", "n_features", "experiment_id", "class_balance", "objective",
           "baseline_log_loss", "host", "version", "notes")


def refit_best(df: DataFrame, estimator, param_map: Mapping, features: Sequence[str]):
    """Fit the chosen parameters on the whole frame and time it."""
    t0 = time.perf_counter()
    model = Pipeline(stages=[assembler(features), estimator.copy(dict(param_map))]).fit(df)
    return model, time.perf_counter() - t0


def glm(df: DataFrame, features: Sequence[str], label: str, family: str, link: str | None = None):
    kw = {"family": family}
    if link:
        kw["link"] = link
    est = GeneralizedLinearRegression(labelCol=label, **kw)
    return Pipeline(stages=[assembler(features), est]).fit(df)
