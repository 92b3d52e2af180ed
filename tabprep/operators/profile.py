"""Data-quality profile (P1–P29) as small DataFrames.

Design: the table is scanned a handful of times, never once per column —
(a) one aggregate of counts/moments over all columns, (b) one frequency table
(column, value, n) from which distinct counts, modes, top values and class
histograms follow, (c) a distributed exact quantile pass, (d) one second
aggregate for rules that need fitted bounds (z-score / IQR outlier counts) with
the bounds inlined as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.config import DEFAULT_SETTINGS, ID_KEYWORDS, Settings
from tabprep.functions.exprs import (
    missing_is_null,     FLOAT_TYPES, datetime_columns, in_bool_infer_set, is_numeric_type, numeric_columns,
    parses_as_datetime, parses_as_number, qcol, string_columns)
from tabprep.functions.freq import column_stats, count_distinct_values, distinct_counts, frequency_table, mode_values, top_values
from tabprep.functions.gram import pair_correlations
from tabprep.functions.quantile import quantiles
from tabprep.operators._long import one_row_long


class ProfilingError(ValueError):
    pass


def check_input(df: DataFrame, target: str | None = None) -> None:
    """Refuse a missing table, no columns, no rows or an unknown target."""
    if df is None:
        raise ProfilingError("DataFrame is None")
    if not isinstance(df, DataFrame):
        raise ProfilingError(f"Expected DataFrame, got {type(df).__name__}")
    if len(df.columns) == 0:
        raise ProfilingError("DataFrame has no columns")
    if df.isEmpty():
        raise ProfilingError("DataFrame is empty (0 rows)")
    if target is not None and target not in df.columns:
        raise ProfilingError(f"Target column '{target}' not found")


def is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, FLOAT_TYPES):
        return qcol(c).isNull() | F.isnan(qcol(c))
    return qcol(c).isNull()


def basic(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
             .withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


@missing_is_null
def missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing) with pct rounded to 2."""
    per = {c: {"n_missing": F.count_if(is_missing(df, c)).cast("long")} for c in df.columns}
    out = one_row_long(df, per, extra={"_n": F.count(F.lit(1))})
    return out.select("column", "n_missing",
                      F.round(F.col("n_missing") * 100.0 / F.col("_n"), 2).alias("pct_missing"))


def missing_flags(miss: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Critical above the drop line (rounded percent); the >50 % warning is only
    raised when no column is critical. ``miss`` is the (small) output of :func:`missing`."""
    crit_line = s.max_missing_ratio * 100
    any_crit = F.max((F.col("pct_missing") > crit_line).cast("int")).over(Window.partitionBy())
    return (miss.withColumn("_any", any_crit)
            .where((F.col("pct_missing") > crit_line)
                   | ((F.col("pct_missing") > s.high_missing_pct) & (F.col("_any") == 0)))
            .select("column", "pct_missing",
                    F.when(F.col("pct_missing") > crit_line, "critical").otherwise("warning")
                    .alias("severity")))


@missing_is_null
def sparse_rows(df: DataFrame) -> DataFrame:
    """P5: rows with more than half of the columns missing."""
    n_cols = len(df.columns)
    miss = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    return df.agg(F.count_if(miss / F.lit(n_cols) > 0.5).cast("long").alias("n_sparse_rows"))


def dtype_group(dt: T.DataType) -> str:
    if is_numeric_type(dt):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


@missing_is_null
def semantic_types(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """(column, dtype, dtype_group, inferred_type, n_unique).

    First match wins: empty → numeric → numeric_with_noise (> 0.8 parse) →
    datetime (all parse) → boolean (all in the boolean set) → categorical."""
    per = {}
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.StringType):
            num, dt_ok, bl = parses_as_number(c), parses_as_datetime(c), in_bool_infer_set(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            num, dt_ok, bl = F.lit(False), c.isNotNull(), F.lit(False)
        else:  # numeric and boolean dtypes are numeric outright
            num, dt_ok, bl = c.isNotNull(), F.lit(False), F.lit(False)
        nn = F.count_if(~is_missing(df, f.name))
        per[f.name] = {"nn": nn.cast("long"),
                       "n_num": F.count_if(c.isNotNull() & num).cast("long"),
                       "n_dt": F.count_if(c.isNotNull() & dt_ok).cast("long"),
                       "n_bool": F.count_if(c.isNotNull() & bl).cast("long")}
    counts = one_row_long(df, per)
    dtypes = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), dtype_group(f.dataType)) for f in df.schema.fields],
        "column string, dtype string, dtype_group string")
    freq = freq if freq is not None else frequency_table(df, df.columns)
    dc = distinct_counts(freq).select("column", "n_distinct")
    inferred = (F.when(F.col("nn") == 0, "empty")
                .when(F.col("n_num") == F.col("nn"), "numeric")
                .when(F.col("n_num") / F.col("nn") > 0.8, "numeric_with_noise")
                .when(F.col("n_dt") == F.col("nn"), "datetime")
                .when(F.col("n_bool") == F.col("nn"), "boolean")
                .otherwise("categorical"))
    return (counts.join(dtypes, "column").join(dc, "column", "left")
            .select("column", "dtype", "dtype_group", inferred.alias("inferred_type"),
                    F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_unique")))


@missing_is_null
def cardinality(df: DataFrame, freq: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """(column, n_distinct, ratio) — distinct non-null values over all rows, ratio rounded 4
    (unrounded kept as ``ratio_raw`` for the rules)."""
    n_rows = n_rows if n_rows is not None else df.count()
    names = df.sparkSession.createDataFrame(
        [(c, dtype_group(df.schema[c].dataType)) for c in df.columns], "column string, dtype_group string")
    dc = (distinct_counts(freq) if freq is not None else count_distinct_values(df, df.columns)).select("column", "n_distinct")
    raw = (F.col("n_distinct") / F.lit(n_rows)) if n_rows else F.lit(0.0)
    return (names.join(dc, "column", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long"))
            .withColumn("ratio_raw", raw.cast("double"))
            .withColumn("ratio", F.round("ratio_raw", 4)))


def id_columns(card: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """distinct/rows > 0.95 and more than 100 distinct."""
    return card.where((F.col("ratio_raw") > s.max_cardinality_ratio)
                      & (F.col("n_distinct") > s.id_min_distinct)).select("column", "n_distinct", "ratio")


def high_cardinality(card: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """P10: string columns with more than 50 distinct values."""
    return card.where((F.col("dtype_group") == "categorical")
                      & (F.col("n_distinct") > s.high_cardinality_distinct)).select("column", "n_distinct")


def low_variance(card: DataFrame) -> DataFrame:
    """Constant (1 distinct) or near constant (ratio < 0.01 and < 5 distinct)."""
    kind = (F.when(F.col("n_distinct") == 1, "constant")
            .when((F.col("ratio_raw") < 0.01) & (F.col("n_distinct") < 5), "low_variance"))
    return card.withColumn("kind", kind).where(F.col("kind").isNotNull()) \
               .select("column", "n_distinct", "kind")


@missing_is_null
def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (nulls equal)."""
    cols = [qcol(c) for c in df.columns]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum(F.col("_c") - 1).cast("long").alias("n_duplicates"),
                 F.sum("_c").cast("long").alias("_n")) \
            .select("n_duplicates",
                    F.round(F.when(F.col("_n") > 0, F.col("n_duplicates") / F.col("_n")).otherwise(0.0), 4)
                    .alias("duplicate_ratio"))


@dataclass
class NumericFit:
    """Small fitted state of the numeric columns (one entry per column)."""
    stats: dict
    q: dict


@missing_is_null
def fit_numeric(df: DataFrame, cols: list[str] | None = None, probs=(0.25, 0.5, 0.75),
                method: str = "exact") -> NumericFit:
    cols = numeric_columns(df) if cols is None else cols
    st = column_stats(df, cols)
    qs = quantiles(df, cols, list(probs), method=method, counts={c: st[c]["n"] for c in cols})
    return NumericFit(st, qs)


@missing_is_null
def outliers(df: DataFrame, s: Settings = DEFAULT_SETTINGS, fit: NumericFit | None = None,
             cols: list[str] | None = None) -> DataFrame:
    """Per numeric column with ≥ 3 values: z-score outliers (|x-mean|/std_pop > 5),
    IQR outliers (outside Q1−3·IQR, Q3+3·IQR), min, max, mean, sample std."""
    cols = numeric_columns(df) if cols is None else cols
    fit = fit or fit_numeric(df, cols, (0.25, 0.75))
    keep = [c for c in cols if (fit.stats[c]["n"] or 0) >= 3]
    if not keep:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, z_outliers long, iqr_outliers long, min double, max double, mean double, std double")
    per = {}
    for c in keep:
        x = qcol(c).cast("double")
        st, q = fit.stats[c], fit.q[c]
        if st["std_pop"] and st["std_pop"] > 0:
            z = F.count_if(F.abs(x - F.lit(st["mean"])) / F.lit(st["std_pop"]) > s.outlier_z)
        else:
            z = F.lit(0)
        iqr = q[0.75] - q[0.25]
        lo, hi = q[0.25] - s.outlier_iqr * iqr, q[0.75] + s.outlier_iqr * iqr
        per[c] = {"n": F.count(x).cast("long"), "z_outliers": z.cast("long"),
                  "iqr_outliers": F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).cast("long"),
                  "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x)}
    return one_row_long(df, per)


def outlier_rules(out: DataFrame) -> DataFrame:
    """A column named ``age`` outside 0..150; IQR outliers above 10 % of the values."""
    age = out.where((F.lower("column") == "age") & ((F.col("min") < 0) | (F.col("max") > 150))) \
             .select("column", F.lit("age_range").alias("rule"), F.col("max").alias("measured"))
    many = out.where(F.col("iqr_outliers") > F.col("n") * 0.1) \
              .select("column", F.lit("many_outliers").alias("rule"),
                      (F.col("iqr_outliers") / F.col("n")).alias("measured"))
    return age.unionByName(many)


@missing_is_null
def numeric_summary(df: DataFrame, fit: NumericFit | None = None, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25 %, 50 %, 75 %, max per numeric column (exact quartiles)."""
    cols = numeric_columns(df) if cols is None else cols
    fit = fit or fit_numeric(df, cols)
    per = {}
    for c in cols:
        x = qcol(c).cast("double")
        q = fit.q[c]
        per[c] = {"count": F.count(x).cast("long"), "mean": F.avg(x), "std": F.stddev_samp(x),
                  "min": F.min(x), "q25": F.lit(q[0.25]).cast("double"),
                  "q50": F.lit(q[0.5]).cast("double"), "q75": F.lit(q[0.75]).cast("double"),
                  "max": F.max(x)}
    return one_row_long(df, per)


def string_summary(df: DataFrame, freq: DataFrame | None = None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per string column (column, n_unique, mode) and its top-k (column, value, n, rank)."""
    cols = string_columns(df)
    freq = freq if freq is not None else frequency_table(df, cols)
    freq = freq.where(F.col("column").isin(cols))
    summary = distinct_counts(freq).join(mode_values(freq), "column") \
        .select("column", F.col("n_distinct").alias("n_unique"), "mode")
    return summary, top_values(freq, k)


@missing_is_null
def correlations(df: DataFrame, cols: list[str] | None = None, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Pairwise-complete Pearson r for every pair i < j of numeric columns, all of them in one scan; null for a pair
    without two values that differ. Empty for fewer than 2 columns."""
    cols = numeric_columns(df) if cols is None else cols
    schema = "feature1 string, feature2 string, r double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i")) \
              .select("i", F.explode(F.expr(f"filter(sequence(0, {len(cols) - 1}), x -> x > i)")).alias("j"))
    return pairs.join(pair_correlations(df, cols), ["i", "j"], "left") \
                .select(F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"), "r")


def high_correlations(corr: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """P20: pairs with |r| > 0.9, r rounded to 3."""
    return corr.where(F.abs("r") > s.high_corr).select("feature1", "feature2", F.round("r", 3).alias("r"))


@missing_is_null
def infer_task(df: DataFrame, target: str, n_unique: int | None = None, s: Settings = DEFAULT_SETTINGS) -> str:
    """Numeric and more than 20 distinct → regression, else classification."""
    if n_unique is None:
        n_unique = df.agg(F.count_distinct(qcol(target))).first()[0]
    numeric = is_numeric_type(df.schema[target].dataType)
    return "regression" if numeric and n_unique > s.regression_min_distinct else "classification"


@missing_is_null
def target_profile(df: DataFrame, target: str, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """(target, n_missing, n_unique, task_type)."""
    t = qcol(target)
    numeric = is_numeric_type(df.schema[target].dataType)
    agg = df.agg(F.count_if(is_missing(df, target)).cast("long").alias("n_missing"),
                 F.count_distinct(t).cast("long").alias("n_unique"))
    task = F.when(F.lit(numeric) & (F.col("n_unique") > s.regression_min_distinct), "regression") \
            .otherwise("classification")
    return agg.select(F.lit(target).alias("target"), "n_missing", "n_unique", task.alias("task_type"))


@missing_is_null
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n), nulls excluded."""
    return df.where(~is_missing(df, target)).groupBy(qcol(target).cast("string").alias("class")) \
             .agg(F.count(F.lit(1)).cast("long").alias("n"))


def class_balance(dist: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """(n_classes, max_n, min_n, ratio, is_balanced, min_class_critical)."""
    g = dist.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                 F.max("n").cast("long").alias("max_n"), F.min("n").cast("long").alias("min_n"))
    ratio = F.col("max_n") / F.col("min_n")
    return g.select("n_classes", "max_n", "min_n", F.round(ratio, 4).alias("ratio"),
                    ((F.col("n_classes") < 2) | (ratio < s.balance_ratio)).alias("is_balanced"),
                    (F.col("min_n") < s.min_samples_per_class).alias("min_class_critical"))


@missing_is_null
def regression_target(df: DataFrame, target: str) -> DataFrame:
    """Min, max, mean, sample std and bias-corrected skewness (G1)."""
    y = qcol(target).cast("double")
    g = df.agg(F.count(y).alias("_n"), F.min(y).alias("min"), F.max(y).alias("max"),
               F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.skewness(y).alias("_g1"))
    n = F.col("_n")
    g1 = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return g.select("min", "max", "mean", "std", g1.alias("skewness"))


@missing_is_null
def leakage(df: DataFrame, target: str, card: DataFrame | None = None, n_rows: int | None = None,
            s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """(column, reason, severity, measured).
    high: numeric feature with |corr(feature, target)| > 0.99;
    medium: name contains an ID keyword and distinct/rows > 0.95."""
    spark = df.sparkSession
    out = spark.createDataFrame([], "column string, reason string, severity string, measured double")
    feats = [c for c in df.columns if c != target]
    if is_numeric_type(df.schema[target].dataType):
        num = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
        if num:
            per = {c: {"r": F.corr(qcol(c).cast("double"), qcol(target).cast("double"))} for c in num}
            r = one_row_long(df, per).where(F.abs("r") > s.leakage_corr)
            out = out.unionByName(r.select("column", F.lit("target_correlation").alias("reason"),
                                           F.lit("high").alias("severity"), F.round("r", 3).alias("measured")))
    named = [c for c in feats if any(k in c.lower() for k in ID_KEYWORDS)]
    if named:
        card = card if card is not None else cardinality(df.select(*[qcol(c) for c in named]), n_rows=n_rows)
        ids = card.where(F.col("column").isin(named) & (F.col("ratio_raw") > s.max_cardinality_ratio))
        out = out.unionByName(ids.select("column", F.lit("id_like").alias("reason"),
                                         F.lit("medium").alias("severity"),
                                         F.round("ratio_raw", 4).alias("measured")))
    return out


FINDINGS_SCHEMA = "rule string, column string, severity string, measured double"


@missing_is_null
def findings(df: DataFrame, target: str | None = None, s: Settings = DEFAULT_SETTINGS,
             outlier_method: str = "exact") -> DataFrame:
    """Every rule's hits gathered into one (rule, column, severity, measured) table.

    The input is scanned by about ten small jobs, so it is persisted for their
    duration; the (small) result is written to the shared checkpoint folder so the
    input can be released before returning."""
    from pyspark import StorageLevel
    from tabprep.session import cut_lineage
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut_lineage(_findings(df, target, s, outlier_method))
    finally:
        df.unpersist()


def _held(rows: DataFrame) -> DataFrame:
    """A result of a row or a few for each column, computed once for all rules that read it."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _findings(df: DataFrame, target: str | None, s: Settings, outlier_method: str) -> DataFrame:
    n_rows = df.count()
    card = _held(cardinality(df, n_rows=n_rows))
    miss = missing(df)
    parts = [
        missing_flags(miss, s).select(F.lit("missing").alias("rule"), "column", "severity",
                                      F.col("pct_missing").cast("double").alias("measured")),
        sparse_rows(df).where(F.col("n_sparse_rows") > 0).select(
            F.lit("sparse_rows").alias("rule"), F.lit(None).cast("string").alias("column"),
            F.lit("warning").alias("severity"), F.col("n_sparse_rows").cast("double").alias("measured")),
        id_columns(card, s).select(F.lit("id_column").alias("rule"), "column", F.lit("warning").alias("severity"),
                                   F.col("ratio").cast("double").alias("measured")),
        high_cardinality(card, s).select(F.lit("high_cardinality").alias("rule"), "column",
                                         F.lit("info").alias("severity"),
                                         F.col("n_distinct").cast("double").alias("measured")),
        low_variance(card).select(F.col("kind").alias("rule"), "column",
                                  F.when(F.col("kind") == "constant", "warning").otherwise("info").alias("severity"),
                                  F.col("n_distinct").cast("double").alias("measured")),
        duplicates(df).where(F.col("n_duplicates") > 0).select(
            F.lit("duplicates").alias("rule"), F.lit(None).cast("string").alias("column"),
            F.lit("warning").alias("severity"), F.col("n_duplicates").cast("double").alias("measured")),
    ]
    num = numeric_columns(df)
    if num:
        fit = fit_numeric(df, num, (0.25, 0.75), method=outlier_method)
        parts.append(outlier_rules(_held(outliers(df, s, fit, num))).select(
            "rule", "column", F.lit("warning").alias("severity"), F.col("measured").cast("double")))
        if len(num) >= 2:
            hc = high_correlations(correlations(df, num, s), s)
            parts.append(hc.select(F.lit("high_correlation").alias("rule"),
                                   F.concat_ws(" ~ ", "feature1", "feature2").alias("column"),
                                   F.lit("warning").alias("severity"), F.col("r").cast("double").alias("measured")))
    if target is not None:
        tp = target_profile(df, target, s)
        parts.append(tp.where(F.col("n_missing") > 0).select(
            F.lit("target_missing").alias("rule"), F.col("target").alias("column"),
            F.lit("critical").alias("severity"), F.col("n_missing").cast("double").alias("measured")))
        if infer_task(df, target, s=s) == "classification":
            bal = _held(class_balance(class_distribution(df, target), s))
            parts.append(bal.where(~F.col("is_balanced")).select(
                F.lit("imbalanced").alias("rule"), F.lit(target).alias("column"),
                F.lit("warning").alias("severity"), F.col("ratio").cast("double").alias("measured")))
            parts.append(bal.where(F.col("min_class_critical")).select(
                F.lit("tiny_class").alias("rule"), F.lit(target).alias("column"),
                F.lit("critical").alias("severity"), F.col("min_n").cast("double").alias("measured")))
        lk = leakage(df, target, card, n_rows, s)
        parts.append(lk.select(F.concat(F.lit("leakage_"), "reason").alias("rule"), "column",
                               F.when(F.col("severity") == "high", "critical").otherwise("info").alias("severity"),
                               "measured"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.coalesce(1)
