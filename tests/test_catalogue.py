"""Every catalogue query runs on the smallest tables; the cheap ones are compared
with their DuckDB oracle (the driver does the full comparison at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from tabprep.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"m08_train_models", "l10_gradient_boosting", "l14_linear_svm", "l09_random_forest", "l11_adaboost",
        "l03_logistic_regression", "l08_decision_tree", "t26_fit_transform", "t25_build_pipeline"}


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rule", "column", "severity", "measured"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n.startswith(("p0", "p1", "x0", "e0", "m0", "s0"))))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _norm(got) == _norm(exp)
