"""Pairwise-complete correlations of many columns in one scan.

A task multiplies blocks of rows as matrices and sends the sums of each pair of columns once; a shuffle on the pair adds
them up. Values are taken relative to the column's mean, from an aggregate before, so that the sums stay precise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.exprs import qcol

#: A sum of squares around the mean below this share of the sum around the column's mean is rounding: no spread.
ROUNDING = 1e-13

_SUMS = ["n", "x", "y", "xx", "yy", "xy", "infinite"]


def _products(shift: np.ndarray):
    """For each pair of columns i < j: sums over the rows in which both have a value."""
    p = len(shift)
    i, j = np.triu_indices(p, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, one, two, both, infinite = np.zeros((5, p, p))
        for b in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float)
            known, huge = (~np.isnan(v)).astype(float), np.isinf(v).astype(float)
            v = np.where(np.isfinite(v), v - shift, 0.0)
            count += known.T @ known
            one += v.T @ known
            two += (v * v).T @ known
            both += v.T @ v
            if huge.any():
                infinite += huge.T @ known + known.T @ huge
        if count.any():
            sums = (count[i, j], one[i, j], one.T[i, j], two[i, j], two.T[i, j], both[i, j], infinite[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(s) for s in sums]], names=["i", "j", *_SUMS])

    return run


def pair_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, r) for the places i < j of two columns with rows in common: their number and Pearson's r over them.

    r is null where a column has no spread in these rows, or holds an infinity. Nulls and NaN are no values. Not more than
    columns x columns / 2 rows leave a task, and one for each column reaches the driver."""
    wide = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    aggs = []
    for c in wide.columns:
        finite = F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c))  # NaN is above infinity
        aggs += [F.avg(finite).alias(f"{c}_mean"), F.min(finite).alias(f"{c}_min"), F.max(finite).alias(f"{c}_max")]
    row = wide.agg(*aggs).first()
    shift = np.zeros(len(cols))
    for k, c in enumerate(wide.columns):
        mean, least, most = row[f"{c}_mean"], row[f"{c}_min"], row[f"{c}_max"]
        if least is not None:  # a constant column is shifted to zero exactly
            shift[k] = least if least == most or not np.isfinite(mean) else mean
    sums = wide.mapInArrow(_products(shift), "i int, j int, " + ", ".join(f"`{s}` double" for s in _SUMS)) \
               .groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    xx, yy = F.col("xx") - x * x / n, F.col("yy") - y * y / n
    spread = (xx > F.col("xx") * ROUNDING) & (yy > F.col("yy") * ROUNDING) & (F.col("infinite") == 0)
    r = (F.col("xy") - x * y / n) / (F.sqrt(xx) * F.sqrt(yy))
    r = F.when(spread, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return sums.where(n > 0).select("i", "j", n.cast("long").alias("n"), F.when(~F.isnan(r), r).alias("r"))
