"""Cleanup of raw tables: what is worked out once, and which rows are left."""
from tabprep.sources import cleanup as C


def test_empty_rows_are_dropped_from_the_kept_table(spark):
    df = spark.createDataFrame([("1", "a"), ("NA", "null"), (" a ", "B"), (None, ""), ("NA", "b"), ("2", None)], "a string, b string")
    typed, decisions = C.cleanup(df)
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("atleastnnonnulls") < plan.index("InMemoryRelation"), plan
    assert "atleastnnonnulls" not in plan[plan.index("InMemoryRelation"):], plan
    assert sorted(map(tuple, typed.collect()), key=str) == sorted([(1.0, "a"), (None, "b"), (2.0, None)], key=str)
    assert {(r.column, r.detail) for r in decisions.collect()} == {("a", "double"), ("b", "string")}
