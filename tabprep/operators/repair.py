"""Column repair (V1–V6): numbers hidden behind units / currency signs and
boolean words, decided per column from one aggregate and applied as one
projection.

Decisions (documented departures): the numeric gate looks at every non-null
value, not the first 100; all commas are removed (so '1,5' → 15, as the
reproduced cleaner does); a column with no value is left unchanged;
``units_ok=True`` runs the gate after the unit letters are stripped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.exprs import (
    clean_numeric_string, in_bool_repair_set, looks_numeric, qcol, string_columns, to_bool_int)
from tabprep.functions.freq import long_form

NUMERIC_GATE = 0.7
CONVERT_SHARE = 0.8


def repair_decisions(df: DataFrame, units_ok: bool = False) -> DataFrame:
    """(column, nn, share_looks_numeric, share_converted, all_bool, kind) per string column."""
    names = string_columns(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, nn long, share_looks_numeric double, share_converted double, kind string")
    # one short expression for the cells of all columns: with one for each column the compiled code is too long to run fast
    c = F.col("value")
    counts = long_form(df, names).groupBy("column").agg(
        F.count(c).cast("long").alias("nn"),
        F.count_if(looks_numeric(c, units_ok)).cast("long").alias("n_look"),
        F.count_if(clean_numeric_string(c).isNotNull()).cast("long").alias("n_conv"),
        F.count_if(~in_bool_repair_set(c)).cast("long").alias("n_nonbool"))
    t = df.sparkSession.createDataFrame([(n,) for n in names], "column string").join(counts, "column", "left").fillna(0)
    look = F.col("n_look") / F.col("nn")
    conv = F.col("n_conv") / F.col("nn")
    kind = (F.when(F.col("nn") == 0, "unchanged")
            .when((look >= NUMERIC_GATE) & (conv > CONVERT_SHARE), "numeric")
            .when(F.col("n_nonbool") == 0, "boolean")
            .otherwise("unchanged"))
    return t.select("column", "nn", F.round(look, 4).alias("share_looks_numeric"),
                    F.round(conv, 4).alias("share_converted"), kind.alias("kind"))


def apply_repair(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    out = []
    for name in df.columns:
        k = decisions.get(name, "unchanged")
        if k == "numeric":
            out.append(clean_numeric_string(qcol(name)).alias(name))
        elif k == "boolean":
            out.append(to_bool_int(qcol(name)).alias(name))
        else:
            out.append(qcol(name))
    return df.select(*out)


def repair_columns(df: DataFrame, units_ok: bool = False) -> tuple[DataFrame, DataFrame]:
    """V6: returns (repaired table, decisions). The input is scanned twice (decide,
    then project), so it is persisted; the caller may unpersist it after use."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    dec = repair_decisions(df, units_ok)
    kinds = {r["column"]: r["kind"] for r in dec.select("column", "kind").collect()}
    return apply_repair(df, kinds), dec
