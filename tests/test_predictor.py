"""Trained learners score tables that already hold the columns they add."""
import pytest
from pyspark.sql import functions as F

from tabprep.operators import split as M
from tabprep.plans import search as SE


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(240).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.when(F.col("id") % 7 > 3, 1.0).otherwise(0.0).alias("label"))
    rows = M.fold_ids(M.train_test_split(rows, F.col("id")), F.col("id"), k=3)
    return rows.where(~F.col("is_test")), rows.where("is_test")


@pytest.mark.parametrize("name", ["dummy", "logistic_regression", "naive_bayes", "decision_tree"])
def test_own_columns_are_replaced(spark, tables, name):
    train, test = tables
    board, models = SE.train_models(train, test, ["a", "b"], "classification", learners=[name])
    row = board.first()
    assert row.status == "ok" and (name == "dummy" or row.test_accuracy > 0.8)
    taken = test.withColumn("prediction", F.lit("old")).withColumn("probability", F.lit(-1)).withColumn("rawPrediction", F.lit(0))
    out = models[name].transform(taken)
    assert out.columns == [*test.columns, "prediction", "probability"]
    got = out.select("label", "prediction", "probability").collect()
    assert len(got) == test.count() and all(r.prediction in (0.0, 1.0) and abs(sum(r.probability) - 1) < 1e-6 for r in got)
