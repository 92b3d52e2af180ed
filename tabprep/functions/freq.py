"""Long form and the frequency table.

Per-column loops become one ``unpivot`` (an ``Expand``) followed by one hash
aggregate on (column, value). Map-side partial aggregation collapses hot values
before the shuffle, so a value holding a third of all rows costs one row per
map task, not a third of the shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.exprs import qcol


def long_form(df: DataFrame, cols: list[str], value_type: str = "string",
              keep_nulls: bool = False, ids: list[str] | None = None) -> DataFrame:
    """(ids..., column, value) with one row per cell of ``cols``."""
    ids = ids or []
    proj = [qcol(i) for i in ids] + [qcol(c).cast(value_type).alias(c) for c in cols]
    out = df.select(*proj).unpivot([qcol(i) for i in ids], [qcol(c) for c in cols], "column", "value")
    if not keep_nulls:
        out = out.where(F.col("value").isNotNull())
    return out


def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): count of each non-null value per column."""
    return (long_form(df, cols)
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def distinct_counts(freq: DataFrame) -> DataFrame:
    """(column, n_distinct, n_non_null) from a frequency table."""
    return freq.groupBy("column").agg(
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
        F.sum("n").cast("long").alias("n_non_null"))


def count_distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct, n_non_null) as ``distinct_counts`` of the frequency table, without it: columns of one type are
    unpivoted together in that type, so that no number or date is written out as text. A column without values has no row."""
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    parts = [df.select(*[qcol(c) for c in same]).unpivot([], [qcol(c) for c in same], "column", "value").where("value is not null")
             .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_distinct"), F.sum("n").cast("long").alias("n_non_null"))
             for same in by_type.values()]
    return functools.reduce(DataFrame.unionByName, parts)


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """(column, value, n, rank): k most frequent values per column, ties → smaller value.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    exchange, so each column's final window sees at most k rows per map task.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return (freq.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def mode_values(freq: DataFrame) -> DataFrame:
    """(column, mode, mode_n): most frequent value, smallest on ties."""
    top = top_values(freq, 1)
    return top.select("column", F.col("value").alias("mode"), F.col("n").alias("mode_n"))


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float]]:
    """One aggregate over all numeric columns: count, mean, population and
    sample std, min, max. Returns a small dict (one entry per column)."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_pop(x).alias(f"sdp{i}"), F.stddev_samp(x).alias(f"sds{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        out[c] = {"n": row[f"n{i}"], "mean": row[f"mean{i}"], "std_pop": row[f"sdp{i}"],
                  "std": row[f"sds{i}"], "min": row[f"min{i}"], "max": row[f"max{i}"]}
    return out
