"""Exact quantiles by counting, without a shuffle of the values.

Spark's exact ``percentile`` keeps a value→count map per group and merges all of it in one final task. Here a wanted rank is
narrowed by histograms whose buckets follow the order of the values:

1. one scan counts every column's values by sign and sixteenths of an octave of their size, with each bucket's smallest and
   largest value: some hundred rows a column, at most 70 000, whatever the table;
2. running sums tell in which bucket a rank lies. A bucket of one distinct value is the answer, however many rows hold it;
3. the buckets left are split into BUCKETS equal parts between their smallest and largest value and counted in one more
   scan for all columns and ranks; only counts are shuffled.

A bucket of step 1 spans 2**48 distinct doubles at most, so that BUCKETS = 2**12 ends after four more scans; columns of
whole numbers or of two decimals take one or two. ``method="approx"`` uses the mergeable ``percentile_approx`` sketch
instead (one pass, bounded memory, documented rank error 1/accuracy).
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.exprs import qcol

#: Parts of a bucket that holds a wanted rank.
BUCKETS = 1 << 12
#: Buckets of an octave in the first scan, and a number above the octaves of doubles (infinity lies in the last).
SIXTEENTHS, OCTAVES = 16, 1100


def _size_bucket(x: Column) -> Column:
    """A whole number that never falls where x grows: sign, and sixteenths of an octave of the size."""
    step = F.floor((F.least(F.log2(F.abs(x)), F.lit(float(OCTAVES - 1))) + F.lit(float(OCTAVES))) * SIXTEENTHS)
    return F.when(x == 0, F.lit(0)).when(x > 0, step).otherwise(-step).cast("long")


def _counted(rows: DataFrame, *key: str) -> dict[tuple, np.ndarray]:
    """Of (key.., bucket, value) rows: for each key the count, smallest and largest value of its buckets, in order."""
    got = rows.groupBy(*key, "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).toArrow().to_pydict()
    found: dict[tuple, list] = defaultdict(list)
    for i, bucket in enumerate(got["bucket"]):
        found[tuple(got[k][i] for k in key)].append((bucket, got["n"][i], got["lo"][i], got["hi"][i]))
    return {k: np.array([x[1:] for x in sorted(v)]) for k, v in found.items()}


class _Open:
    """A range of values lo..hi of one column that holds wanted ranks, counted from the first value in it."""

    def __init__(self, column: int, lo: float, hi: float, ranks: dict[int, int]):
        self.column, self.lo, self.hi, self.ranks = column, lo, hi, ranks


def _locate(column: int, buckets: np.ndarray, ranks: dict[int, int], values: dict) -> list[_Open]:
    """Put the value of each rank that lies in a bucket of one distinct value into ``values``; the other buckets."""
    ends = np.cumsum(buckets[:, 0])
    left: dict[int, dict[int, int]] = defaultdict(dict)
    for rank, inside in ranks.items():
        at = int(np.searchsorted(ends, inside, "right"))
        n, lo, hi = buckets[at]
        if lo == hi:
            values[column, rank] = float(lo)
        else:
            left[at][rank] = int(inside - (ends[at] - n))
    return [_Open(column, float(buckets[at][1]), float(buckets[at][2]), some) for at, some in left.items()]


def _parts_of(long: DataFrame, some: list[_Open]) -> DataFrame:
    """(open, bucket, value) of the rows inside the open ranges; a column's ranges don't overlap."""
    x, own = F.col("value"), F.col("column")
    which, lo, step = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for column in sorted({o.column for o in some}, reverse=True):
        inner = [F.lit(None).cast(t) for t in ("int", "double", "double")]
        for i, o in enumerate(some):
            if o.column == column:
                inside = (x >= F.lit(o.lo)) & (x <= F.lit(o.hi))
                inner = [F.when(inside, F.lit(v)).otherwise(e) for v, e in zip((i, o.lo, o.hi - o.lo), inner, strict=True)]
        which, lo, step = (F.when(own == str(column), e).otherwise(rest) for e, rest in zip(inner, (which, lo, step), strict=True))
    told = long.select("value", which.alias("open"), lo.alias("lo"), step.alias("step")).where("open is not null")
    return told.select("open", F.floor((x - F.col("lo")) / F.col("step") * F.lit(float(BUCKETS))).alias("bucket"), "value")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts: dict[str, int] | None = None) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles (numpy 'linear' / DuckDB quantile_cont) of the values that are neither null nor NaN.

    Returns {column: {p: value}}; a column with no value gets None. ``counts`` are not needed: the first scan counts."""
    if not cols:
        return {}
    names = [str(i) for i in range(len(cols))]
    rows = df.select(*[F.nanvl(qcol(c).cast("double"), F.lit(None)).alias(n) for c, n in zip(cols, names, strict=True)]) \
             .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        long = rows.unpivot([], names, "column", "value").where("value is not null")
        first = _counted(long.withColumn("bucket", _size_bucket(F.col("value"))), "column")
        plan: dict[int, list[tuple[float, int, int, float]]] = {}
        values: dict[tuple[int, int], float] = {}
        some: list[_Open] = []
        for (name,), buckets in first.items():
            column, n = int(name), int(buckets[:, 0].sum())
            plan[column] = []
            for p in probs:
                low = math.floor(p * (n - 1))
                plan[column].append((p, low, min(low + 1, n - 1), p * (n - 1) - low))
            some += _locate(column, buckets, {r: r for _, a, b, _ in plan[column] for r in (a, b)}, values)
        while some:
            parts = _counted(_parts_of(long, some), "open")
            some = [o for i, old in enumerate(some) for o in _locate(old.column, parts[i,], old.ranks, values)]
    finally:
        rows.unpersist()
    out: dict[str, dict[float, float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = dict.fromkeys(probs)
        for p, low, high, share in plan.get(i, ()):
            a, b = values[i, low], values[i, high]
            out[c][p] = a if a == b else a + (b - a) * share
    return out


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = 10000) -> dict[str, dict[float, float | None]]:
    """One-pass mergeable sketch; rank error ≤ n/accuracy."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        arr = row[f"q{i}"]
        out[c] = {p: (None if arr is None else float(arr[j])) for j, p in enumerate(probs)}
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
              counts: dict[str, int] | None = None) -> dict[str, dict[float, float | None]]:
    if method == "approx":
        return approx_quantiles(df, cols, probs)
    return exact_quantiles(df, cols, probs, counts=counts)
