"""Evaluation metrics as aggregates over (truth, prediction, score) columns.

Threshold metrics come from one aggregate of the confusion cells. Ranking
metrics (ROC AUC, average precision) group rows by distinct score and take
running positive/negative counts in descending score order; ties are grouped
as the usual definitions require."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.windows import prefix_sums

LOG_LOSS_EPS = 1e-15


def _div(a, b):
    return a / b if b else 0.0


def confusion_cells(df: DataFrame, truth: str, pred: str, score: str | None = None) -> dict:
    y, p = F.col(truth).cast("int"), F.col(pred).cast("int")
    aggs = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"),
            F.avg(y).alias("base_rate")]
    if score:
        s = F.col(score).cast("double")
        pc = F.least(F.greatest(s, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
        aggs += [F.avg((s - y) * (s - y)).alias("brier"),
                 F.avg(-(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss")]
    else:
        aggs += [F.avg((p - y) * (p - y)).alias("brier")]
    return df.agg(*aggs).first().asDict()


def ranking_metrics(df: DataFrame, truth: str, score: str) -> dict:
    """ROC AUC (ties count one half) and average precision."""
    y = F.col(truth).cast("long")
    g = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    c = prefix_sums(g, [F.col("s").desc()], ["pos", "neg"])
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    r = c.agg(F.sum(F.col("pos") * ((F.lit(N) - F.col("neg_cum")) + 0.5 * F.col("neg"))).alias("auc_num"),
              F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("ap_num")).first()
    auc = r["auc_num"] / (P * N) if P and N else None
    ap = r["ap_num"] / P if P else None
    return {"roc_auc": auc, "average_precision": ap}


def classification_metrics(df: DataFrame, truth: str, pred: str, score: str | None = None,
                           beta: float = 2.0) -> dict:
    c = confusion_cells(df, truth, pred, score)
    tp, fp, tn, fn = c["tp"], c["fp"], c["tn"], c["fn"]
    n = tp + fp + tn + fn
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    spec = _div(tn, tn + fp)
    f1 = _div(2 * precision * recall, precision + recall)
    b2 = beta * beta
    fbeta = _div((1 + b2) * precision * recall, b2 * precision + recall)
    acc = _div(tp + tn, n)
    pe = _div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    kappa = _div(acc - pe, 1 - pe)
    base = c["base_rate"] or 0.0
    ref = base * (1 - base)
    out = {"f1": f1, "accuracy": acc, "recall": recall, "precision": precision,
           "balanced_accuracy": (recall + spec) / 2, "kappa": kappa, f"f{beta:g}": fbeta,
           "brier_loss": c["brier"], "brier_skill": (1 - c["brier"] / ref) if ref else None,
           "tp": tp, "fp": fp, "tn": tn, "fn": fn}
    # a 0/1 prediction is a curve through one point: its area is the balanced
    # accuracy, its average precision two steps
    hard = {"roc_auc": (recall + spec) / 2 if tp + fn and fp + tn else None,
            "average_precision": recall * precision + (1 - recall) * base if tp + fn else None}
    out["roc_auc_hard"] = hard["roc_auc"]
    if score:
        out.update(ranking_metrics(df, truth, score))
        out["log_loss"] = c["log_loss"]
    else:
        out["roc_auc"], out["average_precision"] = hard["roc_auc"], hard["average_precision"]
    return out


def confusion_matrix(df: DataFrame, truth: str, pred: str, normalize: str = "all") -> DataFrame:
    from pyspark.sql import Window
    g = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if normalize == "all":
        w = Window.partitionBy()  # over the (at most classes^2) grouped cells
    elif normalize == "true":
        w = Window.partitionBy("truth")
    else:
        w = Window.partitionBy("pred")
    return g.withColumn("share", F.col("n") / F.sum("n").over(w))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class precision / recall / F1 / support, then macro and weighted
    averages, from the confusion cells (one aggregate)."""
    cells = {(r["truth"], r["pred"]): r["n"] for r in confusion_matrix(df, truth, pred).collect()}
    classes = sorted({k[0] for k in cells} | {k[1] for k in cells})
    rows = []
    total = sum(cells.values())
    for c in classes:
        tp = cells.get((c, c), 0)
        pred_c = sum(v for (t, p), v in cells.items() if p == c)
        sup = sum(v for (t, p), v in cells.items() if t == c)
        pr, rc = _div(tp, pred_c), _div(tp, sup)
        rows.append((str(c), pr, rc, _div(2 * pr * rc, pr + rc), sup))
    k = len(rows)
    macro = tuple(sum(r[i] for r in rows) / k for i in (1, 2, 3))
    weighted = tuple(sum(r[i] * r[4] for r in rows) / total for i in (1, 2, 3))
    rows.append(("macro avg",) + macro + (total,))
    rows.append(("weighted avg",) + weighted + (total,))
    return df.sparkSession.createDataFrame(rows, "class string, precision double, recall double, f1 double, "
                                                 "support long")


def regression_metrics(df: DataFrame, truth: str, pred: str) -> dict:
    r = df.agg(F.sum((F.col(truth) - F.col(pred)) ** 2).alias("sse"), F.var_pop(truth).alias("var"), F.count(F.lit(1)).alias("n")).first()
    sst = (r["var"] or 0.0) * r["n"]
    return {"rmse": math.sqrt(r["sse"] / r["n"]), "r2": 1 - r["sse"] / sst if sst else None, "n": r["n"]}
