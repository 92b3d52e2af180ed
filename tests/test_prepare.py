"""Whole rows are shuffled once for all stages that are fitted on them."""
from pyspark.sql import functions as F

from tabprep.operators import prepare as T


def test_prepared_rows_are_kept(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("y"))
    prepared, ids = T.prepare_data(rows.unionByName(rows), "y")
    assert ids == ["row_id"] and prepared.columns == ["x", "label"]
    assert prepared.count() == rows.where("y is not null").count()
    plan = prepared.select(F.max("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()
