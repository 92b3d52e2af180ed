"""Exploratory checks E1–E10 as DataFrames (the numbers behind the UI's charts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS, Settings
from tabprep.functions.exprs import missing_is_null, numeric_columns, qcol, string_columns
from tabprep.functions.freq import column_stats, frequency_table
from tabprep.functions.quantile import quantiles
from tabprep.operators import profile as P
from tabprep.operators._long import one_row_long

ISSUE_SCHEMA = "issue string, severity string, measured double"


@missing_is_null
def feasibility(df: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Fewer than 50 rows → High."""
    return df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < s.feasibility_min_rows) \
             .select(F.lit("dataset_too_small").alias("issue"), F.lit("High").alias("severity"),
                     F.col("n").cast("double").alias("measured"))


def dimensionality(df: DataFrame) -> DataFrame:
    """Numeric + string columns (target included) outnumber the rows → High."""
    k = len(numeric_columns(df)) + len(string_columns(df))
    return df.agg(F.count(F.lit(1)).alias("n")).where(F.lit(k) > F.col("n")) \
             .select(F.lit("high_dimensionality").alias("issue"), F.lit("High").alias("severity"),
                     F.lit(float(k)).alias("measured"))


@missing_is_null
def iqr_outlier_counts(df: DataFrame, k: float | None = None, cols: list[str] | None = None,
                       s: Settings = DEFAULT_SETTINGS, method: str = "exact") -> DataFrame:
    """Per numeric column, values outside Q1 − k·IQR, Q3 + k·IQR (k = 1.5) and their
    percent of all rows (rounded 2)."""
    k = s.eda_outlier_iqr if k is None else k
    cols = numeric_columns(df) if cols is None else cols
    schema = "column string, n_outliers long, pct double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    st = column_stats(df, cols)
    qs = quantiles(df, cols, [0.25, 0.75], method=method, counts={c: st[c]["n"] for c in cols})
    per = {}
    for c in cols:
        q1, q3 = qs[c][0.25], qs[c][0.75]
        if q1 is None:
            per[c] = {"n_outliers": F.lit(0).cast("long")}
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        x = qcol(c).cast("double")
        per[c] = {"n_outliers": F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).cast("long")}
    out = one_row_long(df, per, extra={"_n": F.count(F.lit(1))})
    return out.select("column", "n_outliers", F.round(F.col("n_outliers") * 100.0 / F.col("_n"), 2).alias("pct"))


def outlier_issue(counts: DataFrame) -> DataFrame:
    """E3 total: any outlier → Medium."""
    return counts.agg(F.sum("n_outliers").alias("t")).where(F.col("t") > 0) \
                 .select(F.lit("outliers").alias("issue"), F.lit("Medium").alias("severity"),
                         F.col("t").cast("double").alias("measured"))


@missing_is_null
def imbalance(df: DataFrame, target: str, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """max/min class size > 3 → Medium, ratio to 1 decimal."""
    d = P.class_distribution(df, target)
    return d.agg((F.max("n") / F.min("n")).alias("r")).where(F.col("r") > s.balance_ratio) \
            .select(F.lit("class_imbalance").alias("issue"), F.lit("Medium").alias("severity"),
                    F.round("r", 1).alias("measured"))


@missing_is_null
def missing_table(df: DataFrame) -> DataFrame:
    """E5: columns with any missing value and their percent (rounded 2)."""
    return P.missing(df).where(F.col("n_missing") > 0)


@missing_is_null
def histogram(df: DataFrame, cols: list[str] | None = None, bins: int | None = None,
              s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), all numeric columns
    in one grouped aggregate: (column, bin, lo, hi, n)."""
    cols = numeric_columns(df) if cols is None else cols
    bins = bins or s.histogram_bins
    st = column_stats(df, cols)
    live = [c for c in cols if st[c]["n"]]
    schema = "column string, bin int, lo double, hi double, n long"
    if not live:
        return df.sparkSession.createDataFrame([], schema)
    cases = []
    for c in live:
        lo, hi = st[c]["min"], st[c]["max"]
        x = qcol(c).cast("double")
        b = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) * bins / F.lit(hi - lo)), F.lit(bins - 1))
        cases.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), b.cast("int")).alias("bin"),
                              F.lit(lo).alias("_min"), F.lit(hi).alias("_max")))
    long = df.select(F.explode(F.array(*cases)).alias("s")).select("s.*").where(F.col("bin").isNotNull())
    g = long.groupBy("column", "bin", "_min", "_max").agg(F.count(F.lit(1)).cast("long").alias("n"))
    w = (F.col("_max") - F.col("_min")) / bins
    return g.select("column", "bin", (F.col("_min") + F.col("bin") * w).alias("lo"),
                    (F.col("_min") + (F.col("bin") + 1) * w).alias("hi"), "n")


@missing_is_null
def missing_advice(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Per column with missing values: drop_column above the threshold percent, else impute."""
    return missing_table(df).select("column", "pct_missing",
                                    F.when(F.col("pct_missing") > threshold, "drop_column").otherwise("impute")
                                    .alias("action"))


@missing_is_null
def apply_missing_decisions(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """drop_column → drop; drop_rows → rows null in that column go; impute → left to the imputer."""
    out = df.drop(*[c for c, a in decisions.items() if a == "drop_column" and c in df.columns])
    rows = [c for c, a in decisions.items() if a == "drop_rows" and c in out.columns]
    return out.na.drop(how="any", subset=rows) if rows else out


@missing_is_null
def input_ranges(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, min, max, mean) of numeric columns for what-if scoring."""
    cols = numeric_columns(df) if cols is None else cols
    per = {c: {"min": F.min(qcol(c).cast("double")), "max": F.max(qcol(c).cast("double")),
               "mean": F.avg(qcol(c).cast("double"))} for c in cols}
    return one_row_long(df, per)


@missing_is_null
def category_domains(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value) distinct values of string columns (distributed, never collected)."""
    cols = string_columns(df) if cols is None else cols
    return frequency_table(df, cols).select("column", "value")
