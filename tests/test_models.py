"""The model queries that no SQL states: closed forms, held-out floors and
agreement between the ways a model is used."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kiln.operators import glm as GLM
from kiln.operators import models as ML
from kiln.operators import sampling as SM
from kiln.operators import stats as ST
from kiln.operators.stats import chisq_sf
from kiln.plans import cat_ml as C
from kiln.plans._q import tables
from kiln.registry import entries
from tests.conftest import SF001, SF01

FEATS = ["n_lines", "qty", "disc", "tax"]


@pytest.fixture(scope="module")
def orders(spark):
    d = C._reg_data(spark, SF001).drop("prediction").withColumnRenamed("truth", "label").persist()
    yield d
    d.unpersist()


@pytest.fixture(scope="module")
def frame(orders):
    return orders.toPandas().sort_values("o_orderkey").reset_index(drop=True)


def run(spark, key, sf=SF001):
    return entries()[key].fn(spark, sf).toPandas()


def r2(y, prediction):
    return 1 - ((y - prediction) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def ols(p):
    x = np.column_stack([np.ones(len(p)), p[FEATS].astype(float)])
    return x @ np.linalg.lstsq(x, p["label"].astype(float), rcond=None)[0]


def test_linear_regression_is_least_squares(spark, frame):
    for key in ("linear_regression", "save_load_model"):
        got = run(spark, key).sort_values("o_orderkey").reset_index(drop=True)
        assert list(got.o_orderkey) == list(frame.o_orderkey) and np.allclose(got.label, frame.label.astype(float))
        assert np.allclose(got.prediction, ols(frame), rtol=1e-6)


def test_pca_is_the_eigendecomposition_of_the_correlations(spark, frame):
    d = C._reg_data(spark, SF001).toPandas().sort_values("o_orderkey")
    x = d[C.FEATS].astype(float).to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    ratio = values[::-1] / values.sum()
    got = run(spark, "pca_explained_variance")
    assert np.allclose(got.explained_variance_ratio, ratio, atol=1e-9) and np.allclose(got.cumulative, ratio.cumsum(), atol=1e-9)
    proj = run(spark, "pca_fit_transform").sort_values("o_orderkey")
    mine = np.abs(z @ vectors[:, ::-1][:, :3])
    assert np.allclose(np.abs(np.array([v.toArray() for v in proj.pca])), mine, atol=1e-6)


@pytest.mark.parametrize("kind, params, floor", [
    ("linear", {}, 0.95), ("tree", {"maxDepth": 8}, 0.85), ("forest", {"maxDepth": 8, "numTrees": 20, "seed": 1}, 0.85),
    ("gbt", {"maxDepth": 4, "maxIter": 20, "seed": 1}, 0.85)])
def test_regressors_on_held_out_orders(spark, orders, kind, params, floor):
    # the table's prices are drawn at random; a known function of the features with noise has something to learn
    noise = (SM.hash_unit("noise", "o_orderkey") - 0.5) * 40
    d = SM.train_test_split(orders.withColumn("y", F.col("qty") * 3 + F.col("n_lines") * 20 + F.col("disc") * 900 + noise), ["o_orderkey"], 0.3)
    m = ML.fit_regressor(d.where("split = 'train'"), kind, FEATS, "y", **params)
    p = m.transform(d.where("split = 'test'")).select("y", "prediction").toPandas().astype(float)
    assert len(p) > 300 and r2(p.y, p.prediction) > floor


@pytest.mark.parametrize("key", ["decision_tree_regression", "score_batch"])
def test_registered_trees_keep_the_rows_and_fit_better_than_the_line(spark, frame, key):
    got = run(spark, key).sort_values("o_orderkey").astype(float)
    assert list(got.o_orderkey) == list(frame.o_orderkey)
    assert r2(got.label, got.prediction) > max(0.1, r2(frame.label.astype(float), ols(frame)))


def test_boosted_classifier_beats_the_majority_on_the_held_out_part(spark):
    got = run(spark, "gbt_classification")
    label = [c for c in got.columns if c not in ("split", "prediction", "probability")][0]
    test = got[got.split == "test"]
    accuracy = (test[label].astype(float) == test.prediction).mean()
    assert set(got.split) == {"train", "test"} and accuracy >= test[label].astype(float).value_counts(normalize=True).max() - 0.02


def test_text_classifier_on_held_out_documents(spark):
    got = run(spark, "mlp_text_classifier", SF01)
    test = got[got.split == "test"]
    assert len(test) > 30 and (test.label == test.prediction).mean() >= test.label.mean() - 0.1


def test_cross_validation_folds_by_hand(spark, orders):
    table = run(spark, "grid_search_cv")
    assert len(table) == 8 and (table.std_metric >= 0).all() and set(table.metric) == {"rmse", "r2"}
    res = table[table.metric == "rmse"]
    assert (res.mean_train <= res.mean_metric * 1.01).all()
    folded = ML.with_folds(orders, ["o_orderkey"], 5).toPandas()
    errors = []
    for k in range(5):
        train, test = folded[folded.fold != k], folded[folded.fold == k]
        x = np.column_stack([np.ones(len(train)), train[FEATS].astype(float)])
        b = np.linalg.lstsq(x, train.label.astype(float), rcond=None)[0]
        e = np.column_stack([np.ones(len(test)), test[FEATS].astype(float)]) @ b - test.label.astype(float)
        errors.append(np.sqrt((e ** 2).mean()))
    plain = res[res.params == "elasticNetParam=0.0;regParam=0.0"].mean_metric.iloc[0]
    assert np.isclose(plain, np.mean(errors), rtol=1e-6)
    best = run(spark, "refit_best")
    assert set(best.params[0].split(";")) == set(res.sort_values("mean_metric").params.iloc[0].split(";")) and best.fit_seconds[0] > 0


def test_experiment_history_has_a_row_for_each_setting(spark):
    got = run(spark, "experiment_grid_loop")
    assert list(got.columns) == list(ML.HISTORY) and len(ML.HISTORY) == 22
    assert len(got) == 8 and set(got.notes) == {"finished"} and got.experiment_id.nunique() == 1
    assert {(r.metric, r.test_size, r.seed, r.n_features) for r in got.itertuples()} == {
        (m, t, s, n) for m in ("f1", "brier_loss") for t in ("0.2", "0.3") for s in ("1",) for n in ("2", "4")}
    assert all(0 <= float(r.best_score) <= 1 and float(r.mean_fit_seconds) > 0 for r in got.itertuples())


def test_comparison_table_holds_each_models_own_error(spark, frame):
    got = run(spark, "model_comparison_table").sort_values("o_orderkey").reset_index(drop=True).astype(float)
    assert np.allclose(got.pred_linear, ols(frame), rtol=1e-6)
    for name in ("linear", "tree"):
        assert np.allclose(got[f"abs_err_{name}"], (got[f"pred_{name}"] - got.label).abs())


def _irls(x, y, family):
    """Iteratively reweighted least squares for logit-binomial and log-gamma."""
    b = np.zeros(x.shape[1])
    if family == "gamma":
        b[0] = np.log(y.mean())
    for _ in range(50):
        eta = x @ b
        if family == "binomial":
            mu = 1 / (1 + np.exp(-eta))
            w, z = mu * (1 - mu), eta + (y - mu) / (mu * (1 - mu))
        else:
            mu = np.exp(eta)
            w, z = np.ones(len(y)), eta + (y - mu) / mu
        b = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * z))
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x))))


def test_binomial_effects_match_reweighted_least_squares(spark):
    t = tables(spark, SF01)
    d = t.documents.join(t.labels, "doc_id").select("quality", "toxic", (F.col("lang") == "en").cast("int").alias("en"), "n_chars").toPandas()
    x = np.column_stack([np.ones(len(d)), d.toxic, d.en, d.n_chars / 1000]).astype(float)
    b, se = _irls(x, d.quality.to_numpy(float), "binomial")
    got = run(spark, "glm_binomial_effects", SF01)
    assert list(got.term) == ["intercept", "toxic", "lang_en", "kchars"]
    assert np.allclose(got.estimate, b, rtol=1e-4, atol=1e-5) and np.allclose(got.std_error, se, rtol=1e-3)
    assert np.allclose(got.wald_chisq, (b / se) ** 2, rtol=1e-2)


def test_gamma_effects_match_reweighted_least_squares(spark, frame):
    x = np.column_stack([np.ones(len(frame)), frame.n_lines, frame.disc, frame.tax]).astype(float)
    b, _ = _irls(x, frame.label.to_numpy(float), "gamma")
    got = run(spark, "glm_gamma_effects")
    assert np.allclose(got.estimate, b, rtol=1e-4, atol=1e-6) and got.p.between(0, 1).all()


def _sum_coded(values, levels):
    return np.array([[1.0 if v == lv else -1.0 if v == levels[-1] else 0.0 for lv in levels[:-1]] for v in values])


def _deviance(x, y, family):
    b, _ = _irls(x, y, family)
    eta = x @ b
    if family == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        return -2 * np.sum(np.where(y == 1, np.log(mu), np.log(1 - mu))), b, mu
    mu = np.exp(eta)
    return 2 * np.sum(-np.log(y / mu) + (y - mu) / mu), b, mu


def _type_three(terms, y, family):
    """{term: (df, LR, Wald)} from whole rows in numpy."""
    one = np.ones((len(y), 1))
    whole = np.column_stack([one, *terms.values()])
    dev, b, mu = _deviance(whole, y, family)
    phi = 1.0 if family == "binomial" else np.sum(((y - mu) / mu) ** 2) / (len(y) - whole.shape[1])
    w = mu * (1 - mu) if family == "binomial" else np.ones(len(y))
    cov = np.linalg.inv(whole.T @ (w[:, None] * whole)) * phi
    out, at = {}, 1
    for name, columns in terms.items():
        rest = np.column_stack([one, *[c for n, c in terms.items() if n != name]])
        k = columns.shape[1]
        s = slice(at, at + k)
        out[name] = (k, (_deviance(rest, y, family)[0] - dev) / phi, b[s] @ np.linalg.solve(cov[s, s], b[s]))
        at += k
    return out


def _check_terms(got, want):
    assert list(got.term) == list(want)
    for r in got.itertuples():
        k, lr, wald = want[r.term]
        assert r.df == k and np.isclose(r.lr_chisq, lr, rtol=1e-4, atol=1e-5) and np.isclose(r.wald_chisq, wald, rtol=1e-3, atol=1e-5)
        assert np.isclose(r.lr_p, chisq_sf(r.lr_chisq, k)) and np.isclose(r.wald_p, chisq_sf(r.wald_chisq, k))


def test_factor_chi_squares_match_nested_fits_over_whole_rows(spark):
    t = tables(spark, SF01)
    d = t.documents.join(t.labels, "doc_id").select("quality", "lang", "toxic").toPandas()
    terms = {f: _sum_coded(d[f].astype(str), sorted(d[f].astype(str).unique())) for f in ("lang", "toxic")}
    _check_terms(run(spark, "glm_binomial_factors", SF01), _type_three(terms, d.quality.to_numpy(float), "binomial"))


def test_one_factor_chi_square_is_the_g_test(spark):
    t = tables(spark, SF01)
    docs = t.documents.join(t.labels, "doc_id").select("quality", "lang")
    n = docs.toPandas().value_counts(["lang", "quality"]).unstack(fill_value=0).to_numpy(float)
    expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
    got = GLM.factor_tests(docs, "quality", [("lang",)], "binomial").first()
    assert got.df == 3 and np.isclose(got.lr_chisq, 2 * np.sum(n * np.log(n / expected)), rtol=1e-5)


def test_gamma_interaction_matches_nested_fits_over_whole_rows(spark):
    d = tables(spark, SF001).orders.select("o_totalprice", "o_orderstatus", "o_orderpriority").toPandas()
    a, b = (_sum_coded(d[c], sorted(d[c].unique())) for c in ("o_orderstatus", "o_orderpriority"))
    both = np.column_stack([a[:, i] * b[:, j] for i in range(a.shape[1]) for j in range(b.shape[1])])
    terms = {"o_orderstatus": a, "o_orderpriority": b, "o_orderstatus:o_orderpriority": both}
    _check_terms(run(spark, "glm_gamma_interaction"), _type_three(terms, d.o_totalprice.to_numpy(float), "gamma"))


def test_factors_beside_a_covariate_and_with_nulls(spark):
    rng = np.random.default_rng(4)
    f, x = rng.choice(["a", "b", "c"], 300), rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x + (f == "a"))))).astype(float)
    rows = [(str(u), float(v), float(w)) for u, v, w in zip(f, x, y)] + [(None, 1.0, 1.0), ("a", None, 0.0), ("b", 0.0, None)]
    got = GLM.factor_tests(spark.createDataFrame(rows, "f string, x double, y double"), "y", [("f",)], "binomial", ["x"]).toPandas()
    design = {"f": _sum_coded(f, ["a", "b", "c"]), "x": x[:, None]}
    _check_terms(got, {"f": _type_three(design, y, "binomial")["f"]})


def test_what_cannot_be_fitted_raises(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 2.0), ("b", "u", 3.0)], "f string, g string, y double")
    with pytest.raises(ValueError, match="no rows for f:g"):
        GLM.factor_tests(df, "y", [("f",), ("g",), ("f", "g")], "gamma")
    with pytest.raises(ValueError, match="1 level"):
        GLM.factor_tests(df.where("f = 'a'"), "y", [("f",)], "gamma")


def test_exact_kolmogorov_p_of_many_small_samples(spark):
    got = run(spark, "ks_exponential_exact")
    assert got.exact.all() and got.p.between(0, 1).all() and (got.n < 100).all()
    one = got[got.n == 1]
    assert np.allclose(one.p, np.minimum(1, 2 * (1 - one.d)))
    r = np.random.default_rng(2)
    n, d = 12, 0.35  # against simulation
    u = np.sort(r.random((40_000, n)), 1)
    i = np.arange(1, n + 1)
    simulated = (np.maximum(i / n - u, u - (i - 1) / n).max(1) >= d).mean()
    df = spark.createDataFrame([(n, d), (n, d), (5000, 0.02), (None, 0.5)], "n long, d double")
    rows = ST.with_kolmogorov_p(df).collect()
    assert len(rows) == 4 and [r.exact for r in sorted(rows, key=lambda r: r.n or 0)] == [None, True, True, False]
    assert all(abs(r.p - simulated) < 0.01 for r in rows if r.n == n)


def test_parallel_search_gives_the_table_of_one_by_one(spark):
    d = tables(spark, SF001).orders.select("o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") % 9).cast("double").alias("x"))
    def score(s):
        return {"mae": s.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]}
    runs = [ML.cross_validate(d, LinearRegression(labelCol="label"), {"regParam": [0.0, 0.5, 5.0]}, score, ["x"], ["o_orderkey"], 3, parallelism=p)
            for p in (1, 6)]
    for a, b in zip(*runs):
        assert a["params"] == b["params"] and np.allclose(a["test"]["mae"], b["test"]["mae"]) and np.allclose(a["train"]["mae"], b["train"]["mae"])
    assert [r["params"] for r in runs[0]] == ["regParam=0.0", "regParam=0.5", "regParam=5.0"]


def test_chunks_cover_the_table(spark):
    got = run(spark, "train_per_chunk")
    chunks = got.drop_duplicates("chunk")
    assert chunks.n_rows.sum() == tables(spark, SF001).lineitem.count()
    assert len(got) == 4 * len(chunks) and got.mean_metric.between(0, 1).all()
    assert (got[got.metric == "accuracy"].mean_metric > 0.5).all()


def test_stream_scores_every_arrival(spark):
    got = run(spark, "stream_score")
    assert len(got) == tables(spark, SF001).events.count() and set(got.prediction) <= {0.0, 1.0}
    label = [c for c in got.columns if c != "prediction"][0]
    assert (got[label].astype(float) == got.prediction).mean() >= got[label].astype(float).value_counts(normalize=True).max() - 0.02
