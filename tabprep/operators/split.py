"""Row cap, train/test split and folds (M1–M5), all driven by a seeded md5 hash
of a row key so that Spark and SQL agree and reruns are identical.

``h = md5('<seed>|' || key)``. The default split needs no sort and no shuffle:
test iff ``int(h[0:8], 16) % 100 < 100·test_size`` — each class is split
independently by the same hash, so class shares hold in expectation. The exact
variant reproduces "ceil(test_size · n) per class" with a distributed rank (no
class ever funnels through one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS, Settings
from tabprep.functions.exprs import qcol
from tabprep.functions.rank import rank_within


def row_hash(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_bucket(h: Column, start: int = 1, modulo: int = 100) -> Column:
    """int(h[start:start+8], 16) % modulo (8 hex digits fit a bigint)."""
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint") % F.lit(modulo)


def whole_row_key(df: DataFrame) -> Column:
    """Key for tables without a primary key: the JSON text of the whole row."""
    return F.to_json(F.struct(*[qcol(c) for c in df.columns]))


def row_cap(df: DataFrame, key: Column, n: int | None, seed: int = 42) -> DataFrame:
    """M1: keep ``n`` rows chosen uniformly by hash order (a sampling operator: the
    limit is the feature). Planned as TakeOrderedAndProject: each task keeps its
    own n best, the merge sees n × tasks rows."""
    if n is None:
        return df
    return df.withColumn("_h", row_hash(key, seed)).orderBy("_h").limit(n).drop("_h")


def matrix_check(df: DataFrame, features: list[str]) -> DataFrame:
    """M2: per feature, nulls, NaN, ±inf and non-numeric columns."""
    from pyspark.sql import types as T
    from tabprep.operators._long import one_row_long
    per = {}
    for c in features:
        dt = df.schema[c].dataType
        numeric = isinstance(dt, (T.NumericType, T.BooleanType))
        x = qcol(c)
        if numeric and isinstance(dt, (T.FloatType, T.DoubleType)):
            per[c] = {"n_null": F.count_if(x.isNull()).cast("long"), "n_nan": F.count_if(F.isnan(x)).cast("long"),
                      "n_inf": F.count_if(F.abs(x) == float("inf")).cast("long"), "is_numeric": F.lit(True)}
        else:
            per[c] = {"n_null": F.count_if(x.isNull()).cast("long"), "n_nan": F.lit(0).cast("long"),
                      "n_inf": F.lit(0).cast("long"), "is_numeric": F.lit(numeric)}
    return one_row_long(df, per)


def train_test_split(df: DataFrame, key: Column, label: str | None = None, s: Settings = DEFAULT_SETTINGS,
                     method: str = "hash") -> DataFrame:
    """M3: adds ``is_test``. ``hash``: bucket < 100·test_size (no shuffle).
    ``exact``: per class the ceil(test_size·n_class) rows with the smallest hash
    (stratified when every class has ≥ 2 rows, else over all rows); a null label is a class."""
    pct = int(round(s.test_size * 100))
    h = df.withColumn("_h", row_hash(key, s.seed))
    if method == "hash":
        return h.withColumn("is_test", hash_bucket(F.col("_h")) < pct).drop("_h")
    group = "_g"
    if label is not None:
        counts = h.groupBy(qcol(label)).count()
        stratify = counts.agg(F.min("count")).first()[0] >= s.min_samples_per_class
    else:
        stratify = False
    h = h.withColumn(group, qcol(label).cast("string") if stratify else F.lit("all"))
    ranked = rank_within(h, group, ["_h"])
    sizes = ranked.groupBy(F.col(group).alias("_size_of")).agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_size_of"))).drop("_size_of")
    return out.withColumn("is_test", F.col("_rank") < F.expr(f"(_n * {pct} + 99) div 100")) \
              .drop("_h", group, "_rank", "_n")


def fold_ids(df: DataFrame, key: Column, label: str | None = None, k: int = 3, seed: int = 42,
             method: str = "hash") -> DataFrame:
    """M4/M5: ``fold`` in [0, k). ``hash``: an independent hash bucket (no shuffle).
    ``stratified``: position within the class by hash, modulo k (round robin); a null label is a class."""
    h = df.withColumn("_h", row_hash(key, seed))
    if method == "hash":
        return h.withColumn("fold", hash_bucket(F.col("_h"), 9, k).cast("int")).drop("_h")
    g = h.withColumn("_g", qcol(label).cast("string"))
    return rank_within(g, "_g", ["_h"]).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_g", "_rank")
