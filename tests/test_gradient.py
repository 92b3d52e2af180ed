"""Gradient boosting over cells against the library's learner."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabprep.operators import gradient as G
from tabprep.operators import learners as L
from tabprep.plans import search as SE


def sample(spark, k=2, n=900, values=12):
    r = np.random.default_rng(5)
    x = r.integers(0, values, (n, 3)).astype(float)
    x[r.random(n) < 0.03, 0] = np.nan
    y = (np.digitize(np.nan_to_num(x[:, 0]) + x[:, 1], [values - 3, values + 3]) + (r.random(n) < 0.15)) % k
    return spark.createDataFrame([(i, Vectors.dense(a.tolist()), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], ["id", "features", "label", "fold"])


@pytest.mark.parametrize("k", [2, 3])
def test_model_is_that_of_the_library(spark, k):
    rows = sample(spark, k).where(~F.exists(vector_to_array("features"), F.isnan))
    classes = [float(c) for c in range(k)]
    _, model = G.search(rows, [{"maxIter": 6, "stepSize": 0.3, "maxDepth": 4}], 0, classes)
    own = GBTClassifier(maxIter=6, stepSize=0.3, maxDepth=4, seed=42)
    plain = (own if k == 2 else OneVsRest(classifier=own)).fit(rows)
    want = {r.id: r for r in plain.transform(rows).collect()}
    for r in model.score(rows, "features").collect():
        assert r.prediction == want[r.id].prediction
        assert r.probability is None if k > 2 else abs(r.probability[1] - want[r.id].probability[1]) < 1e-6
    if k == 2:
        assert np.allclose(model.featureImportances.toArray(), plain.featureImportances.toArray(), atol=0.01)


def test_folds_are_left_out(spark):
    rows = sample(spark)
    cands = [{"maxIter": n, "stepSize": s, "maxDepth": d} for n in (2, 9) for s in (0.1, 0.5) for d in (1, 3)]
    best, _ = G.search(rows, cands, 3, [0.0, 1.0])
    scores = []
    for c in cands:
        got = 0.0
        for f in range(3):
            _, model = G.search(rows.where(F.col("fold") != f), [c], 0, [0.0, 1.0])
            got += model.score(rows.where(F.col("fold") == f), "features").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        scores.append(got)
    assert scores[cands.index(best)] >= max(scores) - 0.02


def test_the_whole_search_takes_few_jobs(spark):
    rows = sample(spark).select("id", "label", "fold", *[vector_to_array("features")[i].alias(f"f{i}") for i in range(3)])
    tracker, group = spark.sparkContext.statusTracker(), "gradient-test"
    spark.sparkContext.setJobGroup(group, group)
    try:
        board, models = SE.train_models(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), ["f0", "f1", "f2"], "classification", fast_only=False, learners=["gradient_boosting"])
        row, jobs = board.first(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert row.status == "ok" and "defaults" not in row.params and row.test_accuracy > 0.7
    assert jobs < 60 and models["gradient_boosting"].kind == "gbt"


def test_more_cells_than_a_task_reads(spark, monkeypatch):
    monkeypatch.setattr(G, "CELLS", 50)
    rows = sample(spark).where((F.col("id") < 200) & ~F.exists(vector_to_array("features"), F.isnan))  # the library takes no NaN
    assert G.search(rows, [{}], 0, [0.0, 1.0]) is None
    lr = next(x for x in L.classification_learners() if x.name == "gradient_boosting")
    model = SE.fit_learner(lr, {"maxIter": 2}, rows, ["features"], "classification", 200, 1.0, [0.0, 1.0])
    assert model.kind == "ml" and model.score(rows).count() == rows.count()
