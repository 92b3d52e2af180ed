"""Training-table preparation T1–T5 (and the E9 decisions, in eda)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS, ID_KEYWORDS, Settings
from tabprep.functions.exprs import qcol
from tabprep.functions.freq import count_distinct_values


class PreparationError(ValueError):
    pass


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """T1."""
    return df.na.drop(how="any", subset=[target])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates (target included); nulls compare equal."""
    return df.dropDuplicates()


def id_like_columns(df: DataFrame, target: str, n_rows: int, s: Settings = DEFAULT_SETTINGS) -> list[str]:
    """T4: feature names with an ID keyword and distinct/rows > 0.95 (measured now)."""
    named = [c for c in df.columns if c != target and any(k in c.lower() for k in ID_KEYWORDS)]
    if not named or not n_rows:
        return []
    dc = {r["column"]: r["n_distinct"] for r in count_distinct_values(df, named).collect()}
    return [c for c in named if dc.get(c, 0) / n_rows > s.max_cardinality_ratio]


def prepare_data(df: DataFrame, target: str, s: Settings = DEFAULT_SETTINGS,
                 label: str = "label") -> tuple[DataFrame, list[str]]:
    """Drop null target, drop duplicates, drop ID-like features, target → ``label``.
    Returns (prepared table, dropped ID columns). Raises on < 10 rows or no feature. The rows without duplicates are
    read again by every stage that is fitted, so they are persisted: whole rows are shuffled once."""
    t = drop_duplicate_rows(drop_null_target(df, target)).persist(StorageLevel.MEMORY_AND_DISK)
    n = t.count()
    ids = id_like_columns(t, target, n, s)
    feats = [c for c in t.columns if c != target and c not in ids]
    if n < s.min_rows:
        raise PreparationError(f"Only {n} rows after cleaning; at least {s.min_rows} needed")
    if not feats:
        raise PreparationError("No feature column left")
    return t.select(*[qcol(c) for c in feats], qcol(target).alias(label)), ids
