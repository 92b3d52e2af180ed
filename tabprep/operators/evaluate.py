"""Metrics X1–X8 and leaderboard M9–M11 over prediction tables
``(label, prediction[, score])``. Every metric is an aggregate; AUC and the ROC
curve use running sums over distinct scores computed range-partitioned, not in
one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.rank import rank_within, running_sums


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """X1."""
    return pred.agg(F.round(F.avg((F.col(label) == F.col(prediction)).cast("double")), 4).alias("accuracy"))


def per_class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, support, predicted) over the union of true and predicted classes."""
    lab = pred.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(label) == F.col(prediction)).alias("tp"))
    prd = pred.groupBy(F.col(prediction).alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    return lab.join(prd, "class", "full").na.fill(0, ["support", "tp", "predicted"])


def weighted_prf(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall, F1 (0 where undefined), rounded 4."""
    c = per_class_counts(pred, label, prediction)
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    c = c.withColumn("p", p).withColumn("r", r) \
         .withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
                     .otherwise(0.0))
    n = F.sum("support")
    return c.agg(F.round(F.sum(F.col("p") * F.col("support")) / n, 4).alias("precision"),
                 F.round(F.sum(F.col("r") * F.col("support")) / n, 4).alias("recall"),
                 F.round(F.sum(F.col("f") * F.col("support")) / n, 4).alias("f1"))


def _score_table(pred: DataFrame, label: str, score: str) -> DataFrame:
    return pred.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("pos"),
        F.count_if(F.col(label) != 1).cast("double").alias("neg"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact AUC with tied scores counted half (rank form), binary labels {0, 1}."""
    t = running_sums(_score_table(pred, label, score), "score", ["neg"])
    # negatives strictly below this score = cum_neg - neg
    return t.agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg")))
         / (F.sum("pos") * F.sum("neg"))).alias("_auc")).select(F.round("_auc", 6).alias("auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, R² (rounded 4)."""
    e = F.col(label) - F.col(prediction)
    g = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                 F.avg(F.col(label)).alias("ybar"), F.count(F.lit(1)).alias("n"),
                 F.var_pop(F.col(label)).alias("vy"))
    return g.select(F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round(1 - F.col("sse") / (F.col("vy") * F.col("n")), 4).alias("r2"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) with predictions rounded to the nearest class."""
    return pred.groupBy(F.col(label).alias("label"),
                        F.round(F.col(prediction)).cast("long").alias("prediction")) \
               .agg(F.count(F.lit(1)).cast("long").alias("n"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score threshold (descending) plus the origin:
    (threshold, fpr, tpr) and ``area`` by the trapezoid rule (= X3)."""
    t = running_sums(_score_table(pred, label, score), "score", ["pos", "neg"], descending=True)
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"], tot["N"]
    pts = t.select(F.col("score").alias("threshold"), (F.col("cum_neg") / F.lit(N)).alias("fpr"),
                   (F.col("cum_pos") / F.lit(P)).alias("tpr"))
    origin = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def roc_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area under a ROC curve table (one row per threshold)."""
    c = rank_within(curve.select(F.lit(0).alias("_g"), "fpr", "tpr"), "_g", ["fpr", "tpr"]).drop("_g")
    before = c.select((F.col("_rank") + 1).alias("_rank"), F.col("fpr").alias("_pf"), F.col("tpr").alias("_pt"))
    c = c.join(before, "_rank")
    return c.agg(F.round(F.sum((F.col("fpr") - F.col("_pf")) * (F.col("tpr") + F.col("_pt")) / 2), 6).alias("area"))


def feature_importance(spark, predictor, k: int = 15) -> DataFrame:
    """(feature, importance) of a trained tree learner, the k largest; empty for learners without importances."""
    imp = getattr(predictor.model, "featureImportances", None)
    vals = [] if imp is None else [float(v) for v in imp.toArray()]
    top = sorted(zip(predictor.features, vals), key=lambda t: (-t[1], t[0]))[:k]
    return spark.createDataFrame(top, "feature string, importance double")


def summary(results: DataFrame, task: str, n_missing: int, baseline: str = "dummy") -> DataFrame:
    """One row: best model and score by M10's metric, its quality band (above 0.9 excellent, above 0.8 good),
    missing cells in total, learners trained and attempted, and advice."""
    best = best_model(results, task, baseline)
    runs = results.agg(F.count_if(F.col("status") == "ok").alias("trained"), F.count(F.lit(1)).alias("attempted"))
    band = F.when(F.col("score") > 0.9, "excellent").when(F.col("score") > 0.8, "good").otherwise("moderate")
    advice = F.concat_ws("; ", F.when(F.col("score") <= 0.8, "add features or rows"),
                         F.when(F.lit(n_missing > 0), "check the source of missing values"),
                         F.when(F.col("trained") < F.col("attempted"), "some learners failed"))
    return runs.join(F.broadcast(best), F.lit(True), "left").select(  # one row each
        "model", "score", band.alias("band"), F.lit(n_missing).cast("long").alias("n_missing"), "trained", "attempted", advice.alias("advice"))


def leaderboard(results: DataFrame, task: str) -> DataFrame:
    """M9: (model, status, metrics…, seconds) ordered by test accuracy / R² descending."""
    key = "test_accuracy" if task == "classification" else "test_r2"
    return results.orderBy(F.col(key).desc_nulls_last(), F.col("position"))


def best_model(results: DataFrame, task: str, baseline: str = "dummy") -> DataFrame:
    """M10 + M11: best by test accuracy / R² (first on ties), baseline only when alone;
    improvement over the baseline in percent (0 when the baseline scores 0)."""
    key = "test_accuracy" if task == "classification" else "test_r2"
    ok = results.where(F.col("status") == "ok")
    cand = ok.where(F.col("model") != baseline)
    n_cand = cand.count()
    pool = cand if n_cand > 0 else ok
    best = pool.orderBy(F.col(key).desc(), F.col("position")).limit(1)
    base_rows = ok.where(F.col("model") == baseline).select(key).limit(1).collect()
    b = base_rows[0][0] if base_rows else None
    score = F.col(key)
    imp = F.lit(0.0) if (b is None or b == 0) else (score - F.lit(b)) / F.lit(abs(b)) * 100
    return best.select("model", score.alias("score"), F.round(imp, 4).alias("improvement_pct"))
