"""Positions and running sums over a global order without a single-task window.

A window with ``orderBy`` and no (or a low-cardinality) ``partitionBy`` sends
every row of a group through one task. Here the rows are range-partitioned
on (group, order, tiebreak), each partition numbers / sums its own rows, and a
small (partitions × groups) table of per-partition totals turns local values
into global ones through a broadcast join. The numbered rows are checkpointed: the
offsets belong to one planned instance of the ranges, so neither a dropped cache nor a
lost executor may plan them again. The tiebreak column keeps every key
distinct so even a group holding a third of all rows is split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.session import cut_lineage


def _n_part(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rank_within(df: DataFrame, group: str, order: list[str], out: str = "_rank",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row inside its ``group`` by ``order``
    (``order`` must make rows unique within a group)."""
    spark = df.sparkSession
    keyed = (df.repartitionByRange(_n_part(df, partitions), group, *order)
             .sortWithinPartitions(group, *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_local", F.monotonically_increasing_id()
                         - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    keyed = cut_lineage(keyed)
    blocks = keyed.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("c"), F.min("_local").alias("s")).collect()
    acc: dict = {}
    offs = []
    for r in sorted(blocks, key=lambda r: (r[group] is None, r[group], r["_pid"])):
        base = acc.get(r[group], 0)
        offs.append((r["_pid"], r[group], base - r["s"]))
        acc[r[group]] = base + r["c"]
    gtype = df.schema[group].dataType.simpleString()
    off = spark.createDataFrame(offs, f"_opid int, _ogroup {gtype}, _shift long")
    same = (F.col("_pid") == F.col("_opid")) & F.col(group).eqNullSafe(F.col("_ogroup"))  # null is a group like others
    return keyed.join(F.broadcast(off), same, "left") \
                .withColumn(out, F.col("_local") + F.col("_shift")).drop("_pid", "_local", "_shift", "_opid", "_ogroup")


def running_sums(df: DataFrame, order: str, cols: list[str], descending: bool = False,
                 partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows ordered at or before this one
    (``order`` unique, e.g. distinct scores). The per-partition prefix sums run in a
    window partitioned by the range partition id, never over the whole table."""
    spark = df.sparkSession
    o = F.col(order).desc() if descending else F.col(order).asc()
    part = cut_lineage(df.repartitionByRange(_n_part(df, partitions), o).withColumn("_pid", F.spark_partition_id()))
    totals = part.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    offs, acc = [], {c: 0 for c in cols}
    for r in sorted(totals, key=lambda r: r["_pid"]):
        offs.append((r["_pid"], *[float(acc[c]) for c in cols]))
        for c in cols:
            acc[c] += r[c] or 0
    off = spark.createDataFrame(offs, "_pid int, " + ", ".join(f"_off_{c} double" for c in cols))
    w = Window.partitionBy("_pid").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    res = part
    for c in cols:
        res = res.withColumn(f"_loc_{c}", F.sum(c).over(w))
    res = res.join(F.broadcast(off), "_pid", "left")
    for c in cols:
        res = res.withColumn(f"cum_{c}", F.col(f"_loc_{c}") + F.col(f"_off_{c}")).drop(f"_loc_{c}", f"_off_{c}")
    return res.drop("_pid")
