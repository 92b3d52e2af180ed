import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabprep.functions.freq import count_distinct_values
from tabprep.functions.gram import pair_correlations
from tabprep.functions.heavy import frequent_values
from tabprep.functions.quantile import exact_quantiles
from tabprep.functions.rank import rank_within, running_sums
from tabprep.functions.lookup import dense_index


def test_exact_quantiles_match_numpy_with_hot_value_and_nulls(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([np.full(400, 5.0), rng.normal(size=800)])  # one value holds a third of the rows
    b = rng.integers(0, 10, size=1200).astype(float)
    pdf = pd.DataFrame({"a": a, "b": b})
    pdf.loc[::7, "b"] = None
    df = spark.createDataFrame(pdf)
    q = exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.75, 1.0])
    for c in ["a", "b"]:
        vals = pdf[c].dropna().to_numpy()
        for p in [0.0, 0.25, 0.5, 0.75, 1.0]:
            assert abs(q[c][p] - np.quantile(vals, p)) < 1e-9


def test_exact_quantiles_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    q = exact_quantiles(df, ["a", "b"], [0.5])
    assert q["a"][0.5] == 1.5 and q["b"][0.5] is None


def test_exact_quantiles_of_any_doubles(spark):
    """Sizes from denormals to near the largest double, both zeros, NaN, infinities, neighbours that differ in the last bit."""
    rng = np.random.default_rng(3)
    wide = rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000)
    near = 1.0 + np.arange(3000) * 2.0 ** -52
    odd = np.concatenate([np.full(900, -np.inf), [0.0, -0.0, 5e-324, -5e-324, 1e-310, np.nan, np.inf], rng.normal(size=93), np.full(2000, 1e308)])
    pdf = pd.DataFrame({"wide.x": wide, "near": rng.permutation(near), "odd": odd, "k": rng.integers(-40, 40, 3000)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 0.1, 0.3, 0.31, 0.32, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, list(pdf.columns), probs)
    for c in pdf.columns:
        values = np.sort(pdf[c].dropna().to_numpy(float))
        for p in probs:
            at = p * (len(values) - 1)
            a, b = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            want = a if a == b else a + (b - a) * (at - int(at))
            assert got[c][p] == want or np.isnan(want) and np.isnan(got[c][p]), (c, p, got[c][p], want)


def test_rank_within_and_running_sums(spark):
    pdf = pd.DataFrame({"g": ["x"] * 50 + ["y"] * 7, "k": list(range(57))})
    df = spark.createDataFrame(pdf)
    r = rank_within(df, "g", ["k"]).toPandas().sort_values("k")
    exp = pdf.groupby("g").cumcount()
    assert list(r["_rank"]) == list(exp)
    t = spark.createDataFrame(pd.DataFrame({"s": np.arange(30, dtype=float), "v": np.ones(30)}))
    out = running_sums(t, "s", ["v"], descending=True).toPandas().sort_values("s", ascending=False)
    assert list(out["cum_v"]) == list(np.arange(1, 31, dtype=float))


def test_dense_index(spark):
    vals = spark.createDataFrame([("c", v) for v in ["b", "a", "d", "c"]] + [("z", "q")], "column string, value string")
    got = {(r["column"], r["value"]): r["idx"] for r in dense_index(vals).collect()}
    assert got == {("c", "a"): 0, ("c", "b"): 1, ("c", "c"): 2, ("c", "d"): 3, ("z", "q"): 0}


def test_distinct_counts_without_text(spark):
    df = spark.createDataFrame([(1, 1.5, "a", None), (1, float("nan"), "b", None), (2, 1.5, None, None)], "k int, `x.y` double, s string, e date")
    got = {(r["column"], r["n_distinct"], r["n_non_null"]) for r in count_distinct_values(df, ["k", "s", "e"]).collect()}
    assert got == {("k", 2, 3), ("s", 2, 2)}


def test_correlations_of_many_columns(spark):
    """Nulls by pair, constants, an infinity, a column far from zero, against pandas."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 90)) @ (rng.normal(size=(90, 90)) * (rng.random((90, 90)) < 0.1))
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(90)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["far"] = 1e9 + rng.normal(size=400)
    pdf["flat"], pdf["none"] = 0.1, np.nan
    pdf["late"] = np.where(np.arange(400) < 200, np.nan, 7.3)
    pdf["early"] = np.where(np.arange(400) < 200, rng.normal(size=400), np.where(np.arange(400) < 300, 0.7, np.nan))
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r.i, r.j): (r.n, r.r) for r in pair_correlations(df, list(pdf.columns)).collect()}
    want = pdf.corr().to_numpy()
    known = pdf.notna().to_numpy().astype(int)
    both = known.T @ known
    for i in range(pdf.shape[1]):
        for j in range(i + 1, pdf.shape[1]):
            n, r = got.get((i, j), (0, None))
            assert n == both[i, j]
            assert (r is None) if np.isnan(want[i, j]) or {pdf.columns[i], pdf.columns[j]} & {"late", "flat"} else abs(r - want[i, j]) < 1e-7, (i, j, r)
    huge = spark.createDataFrame([(1.0, 2.0, 1.0), (float("inf"), 3.0, None), (2.0, 5.0, 2.0)], "a double, b double, c double")
    got = {(r.i, r.j): r.r for r in pair_correlations(huge, ["a", "b", "c"]).collect()}
    assert got[0, 1] is None and abs(got[0, 2] - 1) < 1e-12 and abs(got[1, 2] - 1) < 1e-12
    assert pair_correlations(huge.limit(0), ["a", "b"]).count() == 0


def test_frequent_values_equal_a_full_count(spark):
    """Shares above, at and below the line among thousands of single values, over many tasks and both merges."""
    rng = np.random.default_rng(6)
    a = ["hot"] * 2000 + ["line"] * 60 + ["below"] * 59 + [f"u{i}" for i in range(6000 - 2119)]
    b = [f"v{i}" for i in rng.zipf(1.3, 6000) % 5000]
    pdf = pd.DataFrame({"a.x": rng.permutation(a), "b": b, "c": [None] * 6000, "d": ["one"] * 6000})
    pdf.loc[::3, "b"] = None
    df = spark.createDataFrame(pdf, "`a.x` string, b string, c string, d string").repartition(300)
    found, totals = frequent_values(df, list(pdf.columns), 0.01)
    want = {(c, v, n) for c in pdf.columns for v, n in pdf[c].value_counts().items() if n / pdf[c].count() >= 0.01}
    assert {tuple(r) for r in found.collect()} == want and ("a.x", "line", 60) in want
    assert totals == {c: int(pdf[c].count()) for c in pdf.columns}
