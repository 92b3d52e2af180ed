"""Frozen value → code lookups of any size.

Small vocabularies (≤ ``LITERAL_LIMIT`` entries) become a literal map in the
projection — no join at all. Larger ones are materialised as a parquet table in
the shared checkpoint folder and joined without a hint: Spark broadcasts the table only
while its bytes are below ``spark.sql.autoBroadcastJoinThreshold``.

``dense_index`` numbers sorted distinct values without a global single-task
window: range partitioning + per-partition offsets (the zipWithIndex pattern
expressed with DataFrame operations).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.session import cut_lineage, ensure_checkpoint_dir

LITERAL_LIMIT = 1000


def dense_index(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(column, value) distinct pairs → (column, value, idx) with idx = 0-based
    position of value in sorted order within its column."""
    spark = values.sparkSession
    n_part = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = cut_lineage(
            values.repartitionByRange(n_part, "column", "value")
            .sortWithinPartitions("column", "value")
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_local", F.monotonically_increasing_id()
                        - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    blocks = part.groupBy("_pid", "column").agg(F.count(F.lit(1)).alias("c"), F.min("_local").alias("start")).collect()
    by_col: dict[str, list] = {}
    for r in blocks:
        by_col.setdefault(r["column"], []).append((r["_pid"], r["c"], r["start"]))
    offs = []
    for col, segs in by_col.items():
        acc = 0
        for pid, c, start in sorted(segs):
            offs.append((pid, col, acc - start))
            acc += c
    off_df = spark.createDataFrame(offs, "_pid int, column string, _shift long")
    out = part.join(F.broadcast(off_df), ["_pid", "column"]) \
              .select("column", "value", (F.col("_local") + F.col("_shift")).alias("idx"))
    return out


def store_table(df: DataFrame, prefix: str) -> str:
    """Write a fitted table under the shared checkpoint folder; returns its path."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def literal_lookup(c: Column, mapping: dict, default=None) -> Column:
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.element_at(m, c)
    return out if default is None else F.coalesce(out, F.lit(default))


def join_lookup(df: DataFrame, key: Column, table: DataFrame, value_col: str, out_name: str) -> DataFrame:
    """Left join ``df`` with a (key, value_col) table."""
    t = table.select(F.col("key").alias("_lk_key"), F.col(value_col).alias(out_name))
    return df.withColumn("_lk_probe", key).join(t, F.col("_lk_probe") == F.col("_lk_key"), "left") \
             .drop("_lk_probe", "_lk_key")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
