"""Catalog: evaluation metrics, TF-IDF and models (2.9).

Metrics run on fixed predictions derived from the tables (documents with
their quality labels: prediction = long document, score = length ratio), so
they have exact oracles. Trained models cannot match another library's
numbers and are checked by row count only (no oracle SQL)."""

from __future__ import annotations

import itertools
import socket
import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kiln import __version__
from kiln.functions import hashing as FH
from kiln.operators import glm as GLM
from kiln.operators import metrics as M
from kiln.operators import models as ML
from kiln.operators import profile as PR
from kiln.operators import sampling as SM
from kiln.operators import text as TX
from kiln.plans import conn_prep as CP
from kiln.plans import standins as S
from kiln.plans._q import rounded, tables
from kiln.registry import query
from kiln.session import scratch_path
from kiln.sources.sinks import append_run_history, read_run_history

PRED_SQL = """
pred AS (SELECT d.doc_id, l.quality AS truth, CAST(d.n_chars >= 1000 AS INTEGER) AS pred,
                least(1.0, d.n_chars / 8000.0) AS score
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _pred(spark, sf_dir):
    t = tables(spark, sf_dir)
    d, lab = t.documents, t.labels
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("truth"), (F.col("n_chars") >= 1000).cast("int").alias("pred"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(8000.0)).alias("score"))


def _rank_sql(col):
    return f"""
g_{col} AS (SELECT {col} AS s, sum(truth) AS pos, sum(1 - truth) AS neg FROM pred GROUP BY 1),
c_{col} AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS pc, sum(neg) OVER (ORDER BY s DESC) AS nc FROM g_{col}),
r_{col} AS (SELECT sum(pos * ((t.n - nc) + 0.5 * neg)) / (t.p * t.n) AS auc, sum(pos * pc / (pc + nc)) / t.p AS ap
            FROM c_{col}, (SELECT sum(pos) AS p, sum(neg) AS n FROM g_{col}) t GROUP BY t.p, t.n)"""


METRIC_COLS = ["f1", "accuracy", "recall", "precision", "balanced_accuracy", "kappa", "f2", "brier_loss",
               "brier_skill", "log_loss", "roc_auc", "average_precision", "roc_auc_hard"]


@query("classification_metrics", section="2.9", sql=f"""
WITH {PRED_SQL}, {_rank_sql('score')}, {_rank_sql('pred')},
c AS (SELECT count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
             avg(truth) AS base, avg((score - truth) * (score - truth)) AS brier,
             avg(-(truth * ln(least(greatest(score, 1e-15), 1 - 1e-15))
                   + (1 - truth) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS ll FROM pred),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp,
             (tp + tn) / (tp + fp + tn + fn) AS acc,
             ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) AS pe FROM c)
SELECT round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1, round(acc, 6) AS accuracy,
       round(rc, 6) AS recall, round(pr, 6) AS precision, round((rc + sp) / 2, 6) AS balanced_accuracy,
       round(CASE WHEN 1 - pe <> 0 THEN (acc - pe) / (1 - pe) ELSE 0 END, 6) AS kappa,
       round(CASE WHEN 4 * pr + rc > 0 THEN 5 * pr * rc / (4 * pr + rc) ELSE 0 END, 6) AS f2,
       round(brier, 6) AS brier_loss, round(1 - brier / (base * (1 - base)), 6) AS brier_skill,
       round(ll, 6) AS log_loss, round(r_score.auc, 6) AS roc_auc, round(r_score.ap, 6) AS average_precision,
       round(r_pred.auc, 6) AS roc_auc_hard
FROM m, r_score, r_pred
""")
def q_classification_metrics(spark, sf_dir):
    r = M.classification_metrics(_pred(spark, sf_dir), "truth", "pred", "score")
    return rounded(spark.createDataFrame([tuple(float(r[c]) for c in METRIC_COLS)],
                                         ", ".join(f"{c} double" for c in METRIC_COLS)))


@query("confusion_matrix", section="2.9", sql=f"""
WITH {PRED_SQL}
SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pred GROUP BY 1, 2
""")
def q_confusion_matrix(spark, sf_dir):
    return rounded(M.confusion_matrix(_pred(spark, sf_dir), "truth", "pred"))


@query("classification_report", section="2.9", sql=f"""
WITH {PRED_SQL},
k AS (SELECT cls, count(*) FILTER (WHERE truth = cls AND pred = cls) AS tp, count(*) FILTER (WHERE pred = cls) AS pc,
             count(*) FILTER (WHERE truth = cls) AS sup FROM pred, (VALUES (0), (1)) v(cls) GROUP BY cls),
p AS (SELECT CAST(cls AS VARCHAR) AS class, CASE WHEN pc > 0 THEN tp / pc ELSE 0 END AS precision,
             CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall, sup AS support FROM k),
q AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM q
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM q
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), sum(support) FROM q
""")
def q_classification_report(spark, sf_dir):
    return rounded(M.classification_report(_pred(spark, sf_dir), "truth", "pred"))


REG_SQL = """
ol AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax,
              sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS net FROM lineitem GROUP BY 1),
reg AS (SELECT o_orderkey, o_totalprice AS truth, net AS prediction FROM orders JOIN ol ON o_orderkey = l_orderkey)"""


def _order_features(t):
    li, o = t.lineitem, t.orders
    ol = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        .alias("net"))
    return o.join(ol, o.o_orderkey == ol.l_orderkey).select(
        "o_orderkey", F.col("o_totalprice").alias("truth"), F.col("net").alias("prediction"), "n_lines", "qty", "disc",
        "tax", F.col("o_totalprice").alias("price"))


FEATS = ["n_lines", "qty", "disc", "tax", "prediction"]


@query("regression_metrics", section="2.9", sql=f"""
WITH {REG_SQL}
SELECT round(sqrt(avg((truth - prediction) * (truth - prediction))), 6) AS rmse,
       round(1 - sum((truth - prediction) * (truth - prediction))
                 / sum((truth - (SELECT avg(truth) FROM reg)) * (truth - (SELECT avg(truth) FROM reg))), 6) AS r2,
       count(*) AS n
FROM reg
""")
def q_regression_metrics(spark, sf_dir):
    r = M.regression_metrics(_order_features(tables(spark, sf_dir)), "truth", "prediction")
    return rounded(spark.createDataFrame([(r["rmse"], r["r2"], r["n"])], "rmse double, r2 double, n long"))


@query("sort_truth_vs_prediction", section="2.4", sql=f"""
WITH {REG_SQL}
SELECT o_orderkey, truth, round(prediction, 6) AS prediction,
       row_number() OVER (ORDER BY prediction, o_orderkey) AS rank_prediction,
       row_number() OVER (ORDER BY truth, o_orderkey) AS rank_truth
FROM reg ORDER BY rank_prediction
""")
def q_sort_truth_vs_prediction(spark, sf_dir):
    r = _order_features(tables(spark, sf_dir)).select("o_orderkey", "truth", "prediction")
    r = SM.global_index(r, ["prediction", "o_orderkey"], "rank_prediction")
    r = SM.global_index(r, ["truth", "o_orderkey"], "rank_truth")
    return rounded(r.withColumn("rank_prediction", F.col("rank_prediction") + 1)
                   .withColumn("rank_truth", F.col("rank_truth") + 1)).orderBy("rank_prediction")


TRAIN_DOCS_SQL = "('0x' || substr(md5('123456:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 >= 0.2"


@query("tfidf", section="2.9", sql=f"""
WITH tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
train AS (SELECT doc_id FROM documents WHERE {TRAIN_DOCS_SQL}),
n AS (SELECT count(*) AS n FROM train),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(DISTINCT doc))) + 1.0 AS idf
        FROM tok WHERE doc IN (SELECT doc_id FROM train) GROUP BY term),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
w AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc)
SELECT doc AS doc_id, term, round(w / norm, 6) AS weight FROM w JOIN nm USING (doc)
""")
def q_tfidf(spark, sf_dir):
    d = tables(spark, sf_dir).documents.select("doc_id", "text")
    return rounded(TX.tfidf(d, SM.hash_unit(123456, "doc_id") >= 0.2, "doc_id", "text"))


# ------------------------------------------------------------------ models

def _reg_data(spark, sf_dir):
    return _order_features(tables(spark, sf_dir))


def _scored(model, df, keep):
    return ML.predict(model, df, keep)


@query("linear_regression", section="2.9")
def q_linear_regression(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "linear", ["n_lines", "qty", "disc", "tax"], "label", fitIntercept=True)
    return _scored(m, d, ["o_orderkey", "label"])


@query("decision_tree_regression", section="2.9")
def q_decision_tree_regression(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "tree", ["n_lines", "qty", "disc", "tax"], "label", maxDepth=8)
    return _scored(m, d, ["o_orderkey", "label"])


@query("random_forest_regression", section="2.9")
def q_random_forest_regression(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "forest", ["n_lines", "qty", "disc", "tax"], "label", maxDepth=16, numTrees=100,
                         seed=123456)
    return _scored(m, d, ["o_orderkey", "label"])


@query("gbt_regression", section="2.9")
def q_gbt_regression(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "gbt", ["n_lines", "qty", "disc", "tax"], "label", maxDepth=4, maxIter=100,
                         stepSize=0.1, seed=123456)
    return _scored(m, d, ["o_orderkey", "label"])


def _conn_training(spark, sf_dir):
    prepped = CP.prepare(S.conn_log(tables(spark, sf_dir)))
    feats = [c for c in prepped.columns if c != CP.LABEL]
    return prepped, feats


@query("gbt_classification", section="2.9")
def q_gbt_classification(spark, sf_dir):
    prepped, feats = _conn_training(spark, sf_dir)
    split = SM.train_test_split(prepped, feats, 0.3)  # stable: keyed on the feature values
    train = split.where(F.col("split") == "train")
    m = ML.fit_gbt_classifier(train, [f"`{f}`" if "." in f else f for f in feats], CP.LABEL)
    return m.transform(split).select(CP.LABEL, "split", "prediction", "probability")


@query("mlp_text_classifier", section="2.9")
def q_mlp_text_classifier(spark, sf_dir):
    t = tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    split = SM.train_test_split(d, ["doc_id"], 0.2)
    train = split.where(F.col("split") == "train")
    m = ML.fit_text_classifier(train, "text", "label", ["doc_id"])
    return m.transform(split).select("doc_id", "label", "split", "prediction")


@query("pca_fit_transform", section="2.9")
def q_pca_fit_transform(spark, sf_dir):
    d = _reg_data(spark, sf_dir)
    m = ML.pca_fit(d, FEATS, 3)
    return m.transform(d).select("o_orderkey", "pca")


@query("pca_explained_variance", section="2.9")
def q_pca_explained_variance(spark, sf_dir):
    d = _reg_data(spark, sf_dir)
    ev = ML.explained_variance(ML.pca_fit(d, FEATS, len(FEATS)))
    rows = [(i + 1, v, sum(ev[:i + 1])) for i, v in enumerate(ev)]
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")


GRID = {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}


def _regression_scores(scored):
    m = M.regression_metrics(scored, "label", "prediction")
    return {"rmse": m["rmse"], "r2": m["r2"]}


def _cv(spark, sf_dir, folds=5):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    est = LinearRegression(labelCol="label", solver="normal")
    return d, est, ML.cross_validate(d, est, GRID, _regression_scores, ["n_lines", "qty", "disc", "tax"], ["o_orderkey"], folds)


@query("grid_search_cv", section="2.9")
def q_grid_search_cv(spark, sf_dir):
    """Every parameter set by every scorer, on held-out and on training folds."""
    _, _, results = _cv(spark, sf_dir)
    return ML.cv_table(spark, results, ["rmse", "r2"])


@query("refit_best", section="2.9")
def q_refit_best(spark, sf_dir):
    d, est, results = _cv(spark, sf_dir)
    best = dict(x.split("=") for x in ML.best_of(results, "rmse")["params"].split(";"))
    params = {getattr(est, k): float(v) for k, v in best.items()}
    model, secs = ML.refit_best(d, est, params, ["n_lines", "qty", "disc", "tax"])
    return spark.createDataFrame([(";".join(f"{p.name}={v}" for p, v in params.items()), float(secs))],
                                 "params string, fit_seconds double")


def _labelled_documents(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("toxic"),
        (F.col("lang") == "en").cast("double").alias("lang_en"), (F.col("n_chars") / 1000.0).alias("kchars"),
        (F.size(F.split("text", "\n")) / 10.0).alias("lines"))


def _class_scores(scored):
    m = M.classification_metrics(scored, "label", "prediction")
    return {k: m[k] for k in ("f1", "recall", "precision", "accuracy", "roc_auc", "brier_loss")}


@query("experiment_grid_loop", section="2.9")
def q_experiment_grid_loop(spark, sf_dir):
    """metric x test size x folds x seed x PCA k; one history row per run. A
    fit that fails on its parameters is recorded and the loop goes on."""
    d = _labelled_documents(tables(spark, sf_dir))
    feats = ["toxic", "lang_en", "kchars", "lines"]
    path, experiment = scratch_path(spark, "run-history"), uuid.uuid4().hex
    balance = ";".join(f"{r['label']}={r['n']}" for r in d.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect())
    baseline = PR.class_entropy_log_loss(d, "label").first()["log_loss"]
    x_hash, y_hash = (str(FH.table_fingerprint_md5(d, c).first()["xor_hash"]) for c in (feats, ["label"]))
    grid = {"regParam": [0.0, 0.1]}
    for metric, size, folds, seed, k in itertools.product(["f1", "brier_loss"], [0.2, 0.3], [3], [1], [None, 2]):
        est = LogisticRegression(labelCol="label", maxIter=20)
        started, t0 = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"), time.perf_counter()
        row = {"started_at": started, "metric": metric, "test_size": size, "param_grid": str(grid), "folds": folds, "seed": seed,
               "model_class": type(est).__name__, "scorer": metric, "x_hash": x_hash, "y_hash": y_hash, "n_features": k or len(feats),
               "experiment_id": experiment, "class_balance": balance, "objective": "binary:logistic", "baseline_log_loss": baseline,
               "host": socket.gethostname(), "version": __version__}
        try:
            train = SM.train_test_split(d, ["doc_id"], size, seed=seed).where("split = 'train'").drop("split")
            results = ML.cross_validate(train, est, grid, _class_scores, feats, ["doc_id"], folds, k, seed)
            best = ML.best_of(results, metric)
            row |= {"best_score": best["test"][metric][0], "best_params": best["params"], "grid_seconds": time.perf_counter() - t0,
                    "mean_fit_seconds": sum(r["fit_seconds"] for r in results) / len(results), "notes": "finished"}
        except (IllegalArgumentException, ValueError, ArithmeticError) as exc:
            row |= {"best_score": "failed", "notes": f"failed: {type(exc).__name__}"}
        values = tuple(None if row.get(c) is None else str(row[c]) for c in ML.HISTORY)
        append_run_history(spark.createDataFrame([values], ", ".join(f"{c} string" for c in ML.HISTORY)), path, list(ML.HISTORY))
    return read_run_history(spark, path, list(ML.HISTORY))


@query("save_load_model", section="2.9")
def q_save_load_model(spark, sf_dir):
    from pyspark.ml import PipelineModel
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "linear", ["n_lines", "qty", "disc", "tax"], "label")
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    return _scored(PipelineModel.load(path), d, ["o_orderkey", "label"])


@query("score_batch", section="2.9")
def q_score_batch(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    m = ML.fit_regressor(d, "tree", ["n_lines", "qty", "disc", "tax"], "label", maxDepth=6)
    return _scored(m, d, ["o_orderkey", "label"])


@query("model_comparison_table", section="2.9")
def q_model_comparison_table(spark, sf_dir):
    d = _reg_data(spark, sf_dir).drop("prediction").withColumnRenamed("truth", "label")
    feats = ["n_lines", "qty", "disc", "tax"]
    out = d.select("o_orderkey", "label", *feats)
    for name, kind, kw in [("linear", "linear", {}), ("tree", "tree", {"maxDepth": 6})]:
        m = ML.fit_regressor(d, kind, feats, "label", **kw)
        out = m.transform(out).withColumnRenamed("prediction", f"pred_{name}").drop("features")
        out = out.withColumn(f"abs_err_{name}", F.abs(F.col(f"pred_{name}") - F.col("label")))
    return out.select("o_orderkey", "label", "pred_linear", "pred_tree", "abs_err_linear", "abs_err_tree").orderBy(
        "label", "o_orderkey")


@query("glm_binomial_effects", section="2.8")
def q_glm_binomial_effects(spark, sf_dir):
    t = tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select(
        F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("toxic"),
        (F.col("lang") == "en").cast("double").alias("lang_en"), (F.col("n_chars") / 1000.0).alias("kchars"))
    m = ML.glm(d, ["toxic", "lang_en", "kchars"], "label", "binomial").stages[-1]
    s = m.summary
    names = ["intercept", "toxic", "lang_en", "kchars"]
    coefs = [m.intercept] + list(m.coefficients)
    se = list(s.coefficientStandardErrors)
    se = se[-1:] + se[:-1]  # Spark lists the intercept's error last
    pv = list(s.pValues)
    pv = pv[-1:] + pv[:-1]
    rows = [(n, float(c), float(e), float((c / e) ** 2), float(p)) for n, c, e, p in zip(names, coefs, se, pv)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, wald_chisq double, p double")


@query("glm_gamma_effects", section="2.8")
def q_glm_gamma_effects(spark, sf_dir):
    d = _reg_data(spark, sf_dir).select(F.col("truth").alias("label"), "n_lines", "disc", "tax")
    m = ML.glm(d, ["n_lines", "disc", "tax"], "label", "gamma", "log").stages[-1]
    s = m.summary
    names = ["intercept", "n_lines", "disc", "tax"]
    coefs = [m.intercept] + list(m.coefficients)
    pv = list(s.pValues)
    pv = pv[-1:] + pv[:-1]
    return spark.createDataFrame([(n, float(c), float(p)) for n, c, p in zip(names, coefs, pv)],
                                 "term string, estimate double, p double")


@query("glm_binomial_factors", section="2.8")
def q_glm_binomial_factors(spark, sf_dir):
    """Quality by language and toxicity, both sum-coded factors, one chi-square row each."""
    t = tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select("quality", "lang", "toxic")
    return GLM.factor_tests(d, "quality", [("lang",), ("toxic",)], "binomial")


@query("glm_gamma_interaction", section="2.8")
def q_glm_gamma_interaction(spark, sf_dir):
    """Order value by status x priority: both main effects and the interaction."""
    o = tables(spark, sf_dir).orders
    return GLM.factor_tests(o, "o_totalprice", [("o_orderstatus",), ("o_orderpriority",), ("o_orderstatus", "o_orderpriority")], "gamma")
