"""Model search M6–M8, M13: per learner, seeded random draws from its grid, k-fold
cross-validation on given fold ids, one final fit, metrics on train and test,
wall time; a failing learner becomes a row and the others continue.

The tuned learners run as ``CrossValidator`` over a cached, assembled train set
(``parallelism`` fits candidates concurrently); closed-form ones are single jobs.
"""

from __future__ import annotations

import itertools
import random
import threading
import time
import uuid
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tabprep.config import DEFAULT_SETTINGS, Settings
from tabprep.operators import boosting as B
from tabprep.operators import evaluate as X
from tabprep.operators import gradient as G
from tabprep.operators import learners as L
from tabprep.session import cut_lineage


def draw_candidates(grid: dict, s: Settings = DEFAULT_SETTINGS) -> list[dict]:
    """M7: min(iterations, 5 × number of parameter names) distinct draws, the whole
    grid when it is smaller (grid search when method == 'grid')."""
    if not grid:
        return [{}]
    names = sorted(grid)
    combos = [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]
    if s.search_method == "grid":
        return combos
    n = min(s.search_iterations, 5 * len(names))
    if n >= len(combos):
        return combos
    return random.Random(s.seed).sample(combos, n)


def _metrics(pred: DataFrame, task: str, prefix: str) -> dict:
    if task == "classification":
        a = X.accuracy(pred).first()[0]
        prf = X.weighted_prf(pred).first()
        return {f"{prefix}_accuracy": a, f"{prefix}_precision": prf["precision"], f"{prefix}_recall": prf["recall"],
                f"{prefix}_f1": prf["f1"]}
    m = X.regression_metrics(pred).first()
    return {f"{prefix}_rmse": m["rmse"], f"{prefix}_mae": m["mae"], f"{prefix}_r2": m["r2"]}


def _solvable(learner, features: list[str]):
    """The one-pass solver of linear regression takes at most 4 096 features."""
    if isinstance(learner, LinearRegression) and len(features) > 4096:
        learner.setSolver("l-bfgs")
    return learner


_OWN = ("prediction", "probability", "rawPrediction")


class Predictor:
    """Any trained learner. ``transform`` adds ``prediction`` to a table with the feature columns and, in
    classification, ``probability`` (an array in the order of ``classes``; null for the linear SVM, which has none); columns of
    these names, and ``rawPrediction``, are replaced."""

    def __init__(self, name: str, kind: str, task: str, features: list[str], classes: list[float], model, params: dict,
                 train: DataFrame | None = None):
        self.name, self.kind, self.task, self.features = name, kind, task, features
        self.classes, self.model, self.params, self.train = classes, model, params, train

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in _OWN]  # what an earlier learner added is replaced
        rows = VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df.select(*[F.col(f"`{c}`") for c in keep]))
        return self.score(rows, "__features").select(*[F.col(f"`{c}`") for c in keep], "prediction", *(["probability"] if self.task == "classification" else []))

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """df, which holds assembled features, with prediction and probability."""
        classify = self.task == "classification"
        if self.kind == "baseline":
            value, shares = self.model
            out = df.withColumn("prediction", F.lit(value))
            return out.withColumn("probability", F.array(*[F.lit(x) for x in shares])) if classify else out
        if self.kind == "ml":
            model = self.model.copy()
            model.setFeaturesCol(features)
            out = model.transform(df)
            if classify:
                if "probability" in out.columns:
                    every = vector_to_array("probability")
                    out = out.withColumn("probability", F.array(*[F.get(every, int(c)) for c in self.classes]))
                else:
                    out = out.withColumn("probability", F.lit(None).cast("array<double>"))
            return out
        if self.kind == "nb":
            a = vector_to_array(features)
            wide = df.select("*", *[a[i].alias(n) for i, n in enumerate(self.model.features)])
            return self.model.transform(wide).withColumn("probability", self.model.probability()).drop(*self.model.features)
        if self.kind == "gbt":
            return self.model.score(df, features)
        if self.kind == "adaboost" and classify:
            return B.predict(self.model, self.classes, df, features)
        if self.kind == "adaboost":
            ensemble, classes = self.model
            if features != "features":
                ensemble = [(a, t.copy().setFeaturesCol(features)) for a, t in ensemble]
            return L.adaboost_predict(ensemble, classes, df, self.task, probability="probability")
        # the ids must not change between the search and the join
        rows = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__vec", vector_to_array(features)))
        found = L.knn_predict(self.train, rows, "__id", "__vec", "label", k=self.params.get("k", 5),
                              weights=self.params.get("weights", "uniform"), metric=self.params.get("metric", "euclidean"),
                              task=self.task, shares=classify)
        out = rows.join(found, "__id").drop("__id", "__vec")
        if classify:
            out = out.withColumn("probability", F.array(*[F.coalesce(F.col("shares")[F.lit(c)], F.lit(0.0)) for c in self.classes])).drop("shares")
        return out


def fit_learner(lr, c: dict, rows: DataFrame, features: list[str], task: str, n: int, sd: float, classes: list[float]) -> Predictor:
    """One learner with parameters c on rows of (features, label)."""
    train = None
    if lr.kind == "gbt":
        found = G.search(rows.withColumn("__fold", F.lit(0)), [c], 0, classes, fold="__fold")
        if found:
            return Predictor(lr.name, lr.kind, task, features, classes, found[1], c)
        lr = replace(lr, kind="ml")
    if lr.kind == "baseline":
        if task == "classification":
            counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            model = (L.majority_class(rows), [counts.get(k, 0) / sum(counts.values()) for k in classes])
        else:
            model = (L.mean_value(rows), [])
    elif lr.kind == "ml":
        model = _solvable(lr.make(n, sd, len(classes), **c), features).fit(rows)
    elif lr.kind == "nb":
        names = [f"__f{i}" for i in range(len(features))]
        a = vector_to_array("features")
        model = L.fit_gaussian_nb(rows.select("label", *[a[i].alias(x) for i, x in enumerate(names)]), names,
                                  var_smoothing=c.get("var_smoothing", 1e-9))
        classes = model.classes
    elif lr.kind == "adaboost" and task == "classification":
        model = B.search(rows.withColumn("__fold", F.lit(0)), [c], 0, classes, fold="__fold")[1]
    elif lr.kind == "adaboost":
        model = L.adaboost(rows, task, n_estimators=c.get("n_estimators", 50), learning_rate=c.get("learning_rate", 1.0))
        classes = model[1]
    else:  # knn keeps its train rows in the shared folder
        model = None
        train = cut_lineage(rows.select("label", vector_to_array("features").alias("__vec"))
                            .withColumn("__id", F.monotonically_increasing_id()))
    return Predictor(lr.name, lr.kind, task, features, classes, model, c, train)


def _search(lr, cands: list[dict], tr: DataFrame, fold_col: str, features: list[str], task: str, s: Settings, n, sd, classes,
            parallelism: int) -> dict:
    """The candidate with the best mean accuracy / R² over the folds, the first on ties."""
    if len(cands) < 2:
        return cands[0]
    if lr.kind == "ml":
        # every candidate as a param map of one base estimator; the folds are given, the candidates fit concurrently
        evaluator = (MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification"
                     else RegressionEvaluator(metricName="r2"))
        base = _solvable(lr.make(n, sd, len(classes)), features)
        maps = []
        for c in cands:
            e = _solvable(lr.make(n, sd, len(classes), **c), features)
            maps.append({base.getParam(p.name): v for p, v in e.extractParamMap().items() if e.isSet(p) and base.hasParam(p.name)})
        scores = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=evaluator, numFolds=s.search_folds,
                                foldCol=fold_col, parallelism=parallelism).fit(tr).avgMetrics
    elif lr.kind == "knn":
        scores = _knn_scores(cands, tr, fold_col, task, s, parallelism)
    else:
        def score(run: tuple[dict, int]) -> float:
            c, f = run
            pred = fit_learner(lr, c, tr.where(F.col(fold_col) != f), features, task, n, sd, classes).score(tr.where(F.col(fold_col) == f))
            return X.accuracy(pred).first()[0] if task == "classification" else X.regression_metrics(pred).first()["r2"]

        with ThreadPool(parallelism) as pool:  # candidates are trained concurrently, as CrossValidator does
            got = pool.map(inheritable_thread_target(tr.sparkSession)(score), [(c, f) for c in cands for f in range(s.search_folds)])
        scores = [sum(got[i * s.search_folds:(i + 1) * s.search_folds]) for i in range(len(cands))]
    return cands[max(range(len(cands)), key=lambda i: scores[i])]


def _knn_scores(cands: list[dict], tr: DataFrame, fold_col: str, task: str, s: Settings, parallelism: int) -> list[float]:
    """Each candidate's score summed over the folds: one run of the largest k for each fold and metric answers all."""
    rows = cut_lineage(tr.select("label", fold_col, vector_to_array("features").alias("__vec")).withColumn("__id", F.monotonically_increasing_id()))
    totals = [0.0] * len(cands)
    for metric in sorted({c.get("metric", "euclidean") for c in cands}):
        some = [i for i, c in enumerate(cands) if c.get("metric", "euclidean") == metric]
        for f in range(s.search_folds):
            held = rows.where(F.col(fold_col) == f)
            near = L.knn_neighbours(rows.where(F.col(fold_col) != f), held, "__id", "__vec", "label", max(cands[i].get("k", 5) for i in some), metric).persist()
            near.count()

            def score(i: int) -> float:
                pred = held.join(L.knn_vote(near, "__id", cands[i].get("k", 5), cands[i].get("weights", "uniform"), task), "__id")
                return X.accuracy(pred).first()[0] if task == "classification" else X.regression_metrics(pred).first()["r2"]

            with ThreadPool(parallelism) as pool:
                for i, x in zip(some, pool.map(inheritable_thread_target(tr.sparkSession)(score), some), strict=True):
                    totals[i] += x
            near.unpersist()
    return totals


class TimeLimit:
    """A block whose Spark jobs, those of its threads included, are cancelled after ``seconds``; ``check`` raises from then on."""

    def __init__(self, spark, seconds: float):
        self.sc, self.seconds, self.tag = spark.sparkContext, seconds, f"tabprep-{uuid.uuid4().hex}"
        self.over, self.left = False, threading.Event()

    def _watch(self) -> None:
        wait = self.seconds
        while not self.left.wait(wait):  # jobs that a loop starts later are cancelled too
            self.over, wait = True, 0.5
            self.sc.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.over:
            raise TimeoutError(f"more than {self.seconds} seconds")

    def __enter__(self) -> TimeLimit:
        self.sc.addJobTag(self.tag)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.left.set()
        self.thread.join()
        self.sc.removeJobTag(self.tag)


def train_models(train: DataFrame, test: DataFrame, features: list[str], task: str, s: Settings = DEFAULT_SETTINGS,
                 fast_only: bool = True, learners: list[str] | None = None, fold_col: str = "fold",
                 parallelism: int = 4) -> tuple[DataFrame, dict[str, Predictor]]:
    """M8: returns (results DataFrame, a Predictor for each trained learner). ``train`` carries
    ``features`` columns, ``label`` and ``fold``; ``test`` carries features and label. A search that
    fails (a fold without rows) falls back to the learner's defaults; a learner that fails is a row. One that takes more than
    ``max_training_seconds`` is stopped, its jobs cancelled, and is a ``timeout`` row without metrics or a model."""
    spark = train.sparkSession
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    tr = asm.transform(train).select("features", F.col("label").cast("double").alias("label"), fold_col).persist()
    te = asm.transform(test).select("features", F.col("label").cast("double").alias("label")).persist()
    n, sd = L.label_std(tr)
    classes = sorted(r[0] for r in tr.select("label").distinct().collect()) if task == "classification" else []
    regs = L.classification_learners(fast_only, "svm" in (learners or ())) if task == "classification" else L.regression_learners(fast_only)
    if learners is not None:
        regs = [r for r in regs if r.name in learners]
    rows, models = [], {}
    for pos, lr in enumerate(regs):
        t0 = time.time()
        best, note, model = {}, "", None
        with TimeLimit(spark, s.max_training_seconds) as limit:
            try:
                try:
                    if lr.kind == "adaboost" and task == "classification":  # search and final fit in one lock-step
                        best, stumps = B.search(tr, draw_candidates(lr.grid, s), s.search_folds, classes, fold=fold_col)
                        model = Predictor(lr.name, lr.kind, task, features, classes, stumps, best)
                    elif lr.kind == "gbt" and (found := G.search(tr, draw_candidates(lr.grid, s), s.search_folds, classes, fold=fold_col)):
                        best, model = found[0], Predictor(lr.name, lr.kind, task, features, classes, found[1], found[0])
                    else:
                        lr = replace(lr, kind="ml") if lr.kind == "gbt" else lr  # too many cells: the library's learner
                        best = _search(lr, draw_candidates(lr.grid, s), tr, fold_col, features, task, s, n, sd, classes, parallelism)
                except Exception as e:  # noqa: BLE001 - the defaults are trained instead
                    limit.check()
                    note = f" (defaults: {type(e).__name__})"
                limit.check()
                model = model or fit_learner(lr, best, tr, features, task, n, sd, classes)
                limit.check()
                row = {"model": lr.name, "status": "ok", "position": pos, "params": str(best) + note}
                pte = model.score(te)
                row.update(_metrics(model.score(tr), task, "train"))
                limit.check()
                row.update(_metrics(pte, task, "test"))
                if classes == [0.0, 1.0] and len(model.classes) == 2:
                    row["test_roc_auc"] = X.roc_auc(pte.where("probability is not null").withColumn("score", F.col("probability")[1])).first()[0]
                limit.check()
                models[lr.name] = model
            except Exception as e:  # noqa: BLE001 - a failing learner becomes a row
                row = {"model": lr.name, "status": "timeout" if limit.over else "failed", "position": pos,
                       "params": f"more than {s.max_training_seconds} seconds" if limit.over else f"{type(e).__name__}: {e}"}
        row["seconds"] = round(time.time() - t0, 3)
        rows.append(row)
    keys = ["train_accuracy", "train_precision", "train_recall", "train_f1", "test_accuracy", "test_precision",
            "test_recall", "test_f1", "test_roc_auc"] if task == "classification" else \
        ["train_rmse", "train_mae", "train_r2", "test_rmse", "test_mae", "test_r2"]
    schema = "model string, status string, position int, params string, " + \
             ", ".join(f"{k} double" for k in keys) + ", seconds double"
    data = [tuple([r["model"], r["status"], r["position"], r["params"]] + [
        (float(r[k]) if r.get(k) is not None else None) for k in keys] + [float(r["seconds"])]) for r in rows]
    tr.unpersist()
    te.unpersist()
    return spark.createDataFrame(data, schema), models
