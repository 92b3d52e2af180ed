"""Frequent values of many columns without a shuffle of every distinct value.

Each task keeps a bounded summary of a column: counts of chunks of rows are merged, and when more than ``size`` values are
held, the count of the first one beyond is taken from all (Misra and Gries). Summaries merge in the same way. What is taken
away from one value is at most rows / (size + 1) altogether, so that every value of a larger share survives; one more scan
counts the survivors exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.exprs import qcol
from tabprep.functions.freq import long_form

#: Groups in which the tasks' summaries of a column are merged before the last merge.
MERGES = 256


def _cut(counts: Counter, size: int) -> Counter:
    """At most ``size`` values: the largest, less the count of the next one."""
    if len(counts) <= size:
        return counts
    largest = counts.most_common(size + 1)
    less = largest[size][1]
    return Counter({v: n - less for v, n in largest[:size] if n > less})


def _summaries(names: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in names]
        for b in batches:
            for i, column in enumerate(b.columns):
                found = column.drop_null().value_counts()
                held[i].update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
                held[i] = _cut(held[i], size)
        part = TaskContext.get().partitionId() % MERGES
        for name, counts in zip(names, held, strict=True):
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(counts), t) for x, t in ((name, pa.string()), (part, pa.int32()))]
                                                 + [pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["column", "part", "value", "n"])
    return run


def _merged(size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for v, n in zip(rows["value"], rows["n"], strict=True):
            counts[v] += int(n)
        counts = _cut(counts, size)
        return pd.DataFrame({"column": key[0], "part": 0, "value": list(counts), "n": list(counts.values())})
    return run


def frequent_values(df: DataFrame, cols: list[str], share: float) -> tuple[DataFrame, dict[str, int]]:
    """(column, value, n) of the values, as text, that hold at least ``share`` of a column's non-null values, with exact
    counts, and each column's number of non-null values. At most 2 / share + 1 values a column are counted and broadcast."""
    size = math.ceil(2 / share)
    text = df.select(*[qcol(c).cast("string").alias(str(i)) for i, c in enumerate(cols)])
    row = text.agg(*[F.count(n).alias(n) for n in text.columns]).first()
    totals = {c: row[str(i)] for i, c in enumerate(cols)}
    schema = "column string, part int, value string, n long"
    found = text.mapInArrow(_summaries(cols, size), schema)
    for key in (["column", "part"], ["column"]):
        found = found.groupBy(*key).applyInPandas(_merged(size), schema)
    counted = long_form(df, cols).join(F.broadcast(found.select("column", "value")), ["column", "value"]) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).cast("long").alias("n"))
    tot = df.sparkSession.createDataFrame(list(totals.items()), "column string, tot long")
    return counted.join(F.broadcast(tot), "column").where(F.col("n") / F.col("tot") >= share).select("column", "value", "n"), totals
