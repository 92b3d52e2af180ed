import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabprep.operators import clean as CL
from tabprep.operators import encode as EN
from tabprep.operators import learners as L
from tabprep.operators import split as M
from tabprep.sources import sinks as SK
from tabprep.streaming.scoring import run_to_memory, score_stream


def _titanic_like(spark, n=200):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({
        "Pclass": rng.integers(1, 4, n), "Sex": rng.choice(["male", "female"], n),
        "Age": np.where(rng.random(n) < 0.13, np.nan, rng.normal(30, 10, n)),
        "Fare": rng.exponential(30, n), "Embarked": rng.choice(["S", "C", "Q", None], n, p=[.65, .2, .1, .05]),
        "Survived": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf).withColumn("Age", F.when(F.isnan("Age"), None).otherwise(F.col("Age")))


def test_schema_frozen_for_one_row(spark):
    df = _titanic_like(spark)
    pipe = Pipeline(stages=[CL.MissingValueImputer(), CL.RareCategoryCollapser(), EN.CategoricalEncoder(),
                            EN.NumericScaler(cols=["Age", "Fare"])]).fit(df)
    full = pipe.transform(df)
    one = pipe.transform(df.limit(1))
    unseen = pipe.transform(spark.createDataFrame([(1, "other", 20.0, 5.0, "Z", 0)], df.schema))
    assert full.columns == one.columns == unseen.columns
    assert "Embarked_Q" in full.columns and "Embarked_C" not in full.columns  # first sorted value dropped
    row = unseen.first()
    assert row["Embarked_Q"] == 0 and row["Embarked_S"] == 0
    assert full.where(F.col("Age").isNull()).count() == 0


def test_save_load_identical(spark, tmp_path):
    df = _titanic_like(spark)
    model = Pipeline(stages=[CL.MissingValueImputer(), EN.CategoricalEncoder(), EN.NumericScaler()]).fit(df)
    SK.save_model(model, str(tmp_path), "prep", "classification", df.columns)
    loaded, meta = SK.load_model(str(tmp_path))
    a = model.transform(df).toPandas()
    b = loaded.transform(df).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert meta["task"] == "classification"


def test_split_is_partition_and_deterministic(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 3).cast("int"))
    a = M.train_test_split(df, F.col("id"), label="y", method="exact")
    b = M.train_test_split(df, F.col("id"), label="y", method="exact")
    assert a.count() == 2000
    assert a.where("is_test").count() == sum((n * 20 + 99) // 100 for n in [667, 667, 666])
    assert a.where("is_test").select("id").subtract(b.where("is_test").select("id")).count() == 0


def test_knn_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 4))
    y = rng.integers(0, 3, 120)
    pdf = pd.DataFrame({"id": np.arange(120), "v": list(X), "label": y})
    df = spark.createDataFrame(pdf, "id long, v array<double>, label int")
    train, test = df.where("id < 90"), df.where("id >= 90")
    got = {r["id"]: r["prediction"] for r in L.knn_predict(train, test, "id", "v", "label", k=5, block_rows=17).collect()}
    for i in range(90, 120):
        d = np.sqrt(((X[:90] - X[i]) ** 2).sum(axis=1))
        nn = np.lexsort((np.arange(90), d))[:5]
        votes = np.bincount(y[nn], minlength=3)
        assert got[i] == float(np.argmax(votes))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_neighbours_over_cells(spark, metric):
    """Clusters, copies of one vector, ties, NaN on both sides, equal to a full scan."""
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(size=(150, 3)) + 40 * rng.integers(0, 3, (150, 1)), np.full((80, 3), 2.0), rng.integers(0, 3, (60, 3)).astype(float)])
    X[5, 1] = X[200, 0] = X[260, 2] = np.nan
    test_ids = set(range(0, 290, 6)) | {5, 201}
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 4) for i, v in enumerate(X)], "id long, v array<double>, label int")
    is_test = F.col("id").isin(*test_ids)
    train, test = df.where(~is_test), df.where(is_test)
    ids = [i for i in range(290) if i not in test_ids]
    got = {}
    for k, block in ((7, 11), (239 + 3, 40)):
        for r in L.knn_neighbours(train, test, "id", "v", "label", k=k, metric=metric, block_rows=block).collect():
            got.setdefault((k, r.id), []).append((r._r, r._tid, r._d, r._y))
        for q in test_ids:
            d = np.abs(X[ids] - X[q]).sum(axis=1) if metric == "manhattan" else np.sqrt(((X[ids] - X[q]) ** 2).sum(axis=1))
            want = [ids[j] for j in np.lexsort((ids, d))[:k]]
            assert [t for _, t, _, _ in sorted(got[k, q])] == want, (metric, k, q)


def test_knn_routes_leave_far_cells_out():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0]])
    rows, least, most = np.array([50.0, 50.0, 50.0]), np.zeros(3), np.full(3, 5.0)
    test = pd.DataFrame({"id": [1, 2], "v": [[1.0, 1.0], [52.0, 0.0]]})
    first = pd.concat(L._routes(pivots, rows, least, most, 5, "euclidean", "v", False)([test]))
    assert sorted(zip(first.id, first._cell)) == [(1, 0), (2, 1)]
    more = pd.concat(L._routes(pivots, rows, least, most, 5, "euclidean", "v", True)([test.assign(_reach=[3.0, 60.0])]))
    assert sorted(zip(more.id, more._cell)) == [(2, 0)]


def test_slow_learner_is_stopped(spark, monkeypatch):
    """A learner past its limit is a row without a model, its jobs end, and the others go on."""
    import dataclasses
    import time
    from tabprep.config import DEFAULT_SETTINGS
    from tabprep.plans import search as SE
    df = spark.range(120).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    plain = SE._search

    def slow(lr, *rest):
        if lr.name == "decision_tree":
            spark.range(8, numPartitions=8).mapInPandas(lambda frames: (time.sleep(120) or f for f in frames), "id long").count()
        return plain(lr, *rest)

    monkeypatch.setattr(SE, "_search", slow)
    t = time.time()
    board, models = SE.train_models(df, df, ["x"], "classification", dataclasses.replace(DEFAULT_SETTINGS, max_training_seconds=25), learners=["dummy", "decision_tree", "naive_bayes"])
    got = {r.model: r for r in board.collect()}
    assert time.time() - t < 100
    assert got["decision_tree"].status == "timeout" and got["decision_tree"].test_accuracy is None and "decision_tree" not in models
    assert got["dummy"].status == got["naive_bayes"].status == "ok" and {"dummy", "naive_bayes"} <= set(models)


def test_adaboost_runs_and_predicts(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(300).withColumn("x", (F.col("id") % 17).cast("double")) \
              .withColumn("label", (F.col("x") > 8).cast("double"))
    tr = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    ens, classes = L.adaboost(tr, "classification", n_estimators=5)
    pred = L.adaboost_predict(ens, classes, tr, "classification")
    acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc == 1.0


def test_stream_scoring(spark, tmp_path):
    df = _titanic_like(spark)
    model = Pipeline(stages=[CL.MissingValueImputer(), EN.CategoricalEncoder(), EN.NumericScaler()]).fit(df)
    src = str(tmp_path / "src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = run_to_memory(score_stream(model, stream), "scored_stream", str(tmp_path / "ck"))
    q.stop()
    assert spark.table("scored_stream").count() == df.count()


def test_ranks_outlive_the_cache(spark):
    from tabprep.functions.rank import rank_within
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.xxhash64("id").alias("o"))
    ranked = rank_within(df, "g", ["o"])
    spark.catalog.clearCache()
    assert ranked.agg(F.count_distinct("_rank"), F.min("_rank"), F.max("_rank")).first()[:] == (1_000_000, 0, 999_999)


def test_labels_beyond_the_literal_limit(spark):
    from tabprep.operators.encode import LabelIndexer
    df = spark.range(5000).select(F.format_string("c%05d", "id").alias("label"), "id")
    model = LabelIndexer().fit(df)
    out = model.decode(model.transform(df), "label_idx", "back")
    assert out.where("label_idx = id and back = label").count() == 5000


def test_nan_is_missing_and_indicators_stay(spark):
    from pyspark.ml import Pipeline
    from tabprep.operators import clean, encode, profile
    df = spark.range(10).select(F.when(F.col("id") < 5, float("nan")).otherwise(F.col("id").cast("double")).alias("x"),
                                F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("c"))
    assert {r["column"]: r["n_missing"] for r in profile.missing(df).collect()}["x"] == 5
    model = Pipeline(stages=[clean.MissingValueImputer(), encode.CategoricalEncoder(), encode.NumericScaler(),
                             encode.FeatureEngineer()]).fit(df)
    out = model.transform(df)
    assert out.where("isnan(x) or x is null").count() == 0
    others = [c for c in out.columns if c not in ("x",)]
    assert not [c for c in others if c.startswith("c_") and c.endswith("_squared")]
    assert {r[0] for r in out.select([c for c in out.columns if c.startswith("c_")][0]).distinct().collect()} == {0, 1}


def test_knn_with_text_classes(spark):
    df = spark.range(40).select("id", F.array(F.col("id").cast("double")).alias("v"),
                                F.when(F.col("id") < 20, "low").otherwise("high").alias("label"))
    got = L.knn_predict(df, df, "id", "v", "label", k=3, block_rows=7, shares=True).collect()
    assert len(got) == 40
    assert all(r["prediction"] == ("low" if r["id"] < 20 else "high") for r in got if r["id"] not in (19, 20))


def test_split_and_folds_keep_null_labels(spark):
    from tabprep.operators import split as M
    rows = spark.range(100).select("id", F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("label"))
    found = M.train_test_split(rows, F.col("id"), "label", method="exact").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("test")).collect()
    assert {r.label: (r.n, r.test) for r in found} == {None: (20, 4), "0": (40, 8), "1": (40, 8)}
    folds = M.fold_ids(rows, F.col("id"), "label", k=4, method="stratified").groupBy("label", "fold").count().collect()
    assert {(r.label, r.fold): r["count"] for r in folds} == {(c, f): n for c, n in ((None, 5), ("0", 10), ("1", 10)) for f in range(4)}
