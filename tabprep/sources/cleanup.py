"""Post-read cleanup of an all-string table.

Order (decision: repeated headers go before type inference so such columns
still become numeric): S14 repeated header rows → S7 NA tokens → S11 empty
rows → S12/S13 empty and unnamed columns → S8 type inference. Every step is a
projection or filter; the decisions of S8/S12/S13 come from one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.config import DEFAULT_SETTINGS, Settings
from tabprep.functions.exprs import (
    na_to_null, parses_as_bool_literal, parses_as_integer, parses_as_number, qcol, strip_ws)
from tabprep.operators._long import one_row_long


def is_header_row(df: DataFrame):
    """True where every cell equals its column name (lower-cased, trimmed)."""
    cond = F.lit(len(df.columns) > 0)
    for c in df.columns:
        cond = cond & F.coalesce(F.lower(F.trim(qcol(c).cast("string"))) == F.lit(c.strip().lower()), F.lit(False))
    return cond


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Drop rows equal to the header line."""
    if len(df.columns) == 0:
        return df
    return df.where(~is_header_row(df))


def na_tokens_to_null(df: DataFrame, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Exact NA tokens → null on every string column."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        out.append(na_to_null(c, s.missing_tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(*out)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every column is null."""
    return df.na.drop(how="all")


def column_census(df: DataFrame) -> dict[str, dict[str, int]]:
    """One aggregate: per column non-null count and, for strings, how many values
    read as integer / number / boolean literal. Returns a small dict."""
    per = {}
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.StringType):
            per[f.name] = {"nn": F.count(c), "n_int": F.count_if(parses_as_integer(c)),
                           "n_num": F.count_if(parses_as_number(c)),
                           "n_bool": F.count_if(parses_as_bool_literal(c))}
        else:
            per[f.name] = {"nn": F.count(c), "n_int": F.lit(0).cast("long"),
                           "n_num": F.lit(0).cast("long"), "n_bool": F.lit(0).cast("long")}
    rows = one_row_long(df, per, extra={"_n": F.count(F.lit(1))}).collect()
    return {r["column"]: {"nn": r["nn"], "n_int": r["n_int"], "n_num": r["n_num"],
                          "n_bool": r["n_bool"], "n": r["_n"]} for r in rows}


def empty_columns(census: dict[str, dict[str, int]], s: Settings = DEFAULT_SETTINGS) -> list[str]:
    """S12 + S13: entirely null columns, and unnamed (blank-header) columns above 95 % null."""
    out = []
    for c, m in census.items():
        if m["nn"] == 0:
            out.append(c)
        elif c.lower().startswith("unnamed:") and m["n"] and (m["n"] - m["nn"]) / m["n"] > s.max_missing_ratio:
            out.append(c)
    return out


def infer_types(census: dict[str, dict[str, int]]) -> dict[str, str]:
    """Whole-column inference as a delimited-file reader does it: all integers →
    bigint (double when some are missing), all numbers → double, all true/false →
    boolean (only without missing), else string. Only string columns change."""
    out = {}
    for c, m in census.items():
        nn, n = m["nn"], m["n"]
        if nn == 0:
            out[c] = "string"
        elif m["n_int"] == nn:
            out[c] = "bigint" if nn == n else "double"
        elif m["n_num"] == nn:
            out[c] = "double"
        elif m["n_bool"] == nn and nn == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, want = qcol(f.name), types.get(f.name, "string")
        if not isinstance(f.dataType, T.StringType) or want == "string":
            out.append(c)
        elif want == "boolean":
            out.append((F.lower(strip_ws(c)) == "true").alias(f.name))
        else:
            out.append(strip_ws(c).try_cast(want).alias(f.name))
    return df.select(*out)


def cleanup(df: DataFrame, s: Settings = DEFAULT_SETTINGS) -> tuple[DataFrame, DataFrame]:
    """S11–S14 + S7 + S8 on a freshly read all-string table.
    Returns (typed table, decisions (column, action, detail))."""
    from pyspark import StorageLevel
    spark = df.sparkSession
    # scanned by the census aggregate and by the typed projection: persist once. Empty rows are dropped from what is kept:
    # before it, Spark would work out every cell a second time to filter it, in one method too long for the JVM to compile
    stage = drop_empty_rows(na_tokens_to_null(drop_repeated_headers(df), s).persist(StorageLevel.MEMORY_AND_DISK))
    census = column_census(stage)
    drop = empty_columns(census, s)
    kept = stage.drop(*drop)
    types = infer_types({c: m for c, m in census.items() if c not in drop})
    decisions = [(c, "drop_empty_column", None) for c in drop] + \
                [(c, "type", t) for c, t in types.items()]
    return apply_types(kept, types), spark.createDataFrame(decisions, "column string, action string, detail string")
