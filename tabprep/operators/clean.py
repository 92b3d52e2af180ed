"""Cleaning stages T6–T13 (fit = small aggregates, transform = one projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.config import DEFAULT_SETTINGS
from tabprep.functions.exprs import is_numeric_type, numeric_columns, parses_as_number, qcol, string_columns, strip_ws
from tabprep.functions.freq import column_stats, distinct_counts, frequency_table, mode_values
from tabprep.functions.heavy import frequent_values
from tabprep.functions.quantile import quantiles
from tabprep.operators._long import one_row_long
from tabprep.operators.base import TabEstimator, TabModel

S = DEFAULT_SETTINGS


def _missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    per = {c: {"m": F.count_if(qcol(c).isNull()).cast("long")} for c in df.columns}
    rows = one_row_long(df, per, extra={"_n": F.count(F.lit(1))}).collect()
    n = rows[0]["_n"] if rows else 0
    return n, {r["column"]: r["m"] for r in rows}


# ------------------------------------------------------------------ T6/T7 imputation

class MissingValueImputer(TabEstimator):
    """T6/T7. fit: drop columns above the missing line (unrounded ratio); impute the
    columns that have nulls: numeric → median (exact, distributed) / mean / constant,
    other → most frequent value (smallest on ties). Columns without nulls at fit get
    no imputer. ``strategy``: auto | median | mean | mode | constant."""

    defaults = {"strategy": "auto", "max_missing_ratio": S.max_missing_ratio, "fill_value": None,
                "quantile_method": "exact"}

    def _fit(self, df: DataFrame) -> "MissingValueImputerModel":
        o = self.opts
        n, miss = _missing_counts(df)
        drop = [c for c, m in miss.items() if n and m / n > o["max_missing_ratio"]]
        need = [c for c, m in miss.items() if m > 0 and c not in drop]
        num = [c for c in need if is_numeric_type(df.schema[c].dataType)]
        other = [c for c in need if c not in num]
        fill: dict[str, object] = {}
        strategy = o["strategy"]
        if strategy == "constant":
            for c in need:
                fill[c] = o["fill_value"] if o["fill_value"] is not None else (0 if c in num else "missing")
        else:
            num_mode = num if strategy == "mode" else []
            num_stat = [c for c in num if c not in num_mode]
            if num_stat and strategy == "mean":
                st = column_stats(df, num_stat)
                fill.update({c: st[c]["mean"] for c in num_stat})
            elif num_stat:
                qs = quantiles(df, num_stat, [0.5], method=o["quantile_method"],
                               counts={c: n - miss[c] for c in num_stat})
                fill.update({c: qs[c][0.5] for c in num_stat})
            mode_cols = other + num_mode
            if mode_cols:
                modes = mode_values(frequency_table(df, mode_cols)).collect()
                for r in modes:
                    v = r["mode"]
                    fill[r["column"]] = float(v) if r["column"] in num_mode else v
        types = {c: df.schema[c].dataType.simpleString() for c in fill}
        return MissingValueImputerModel(state={"drop": drop, "fill": fill, "types": types})


class MissingValueImputerModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        drop = set(st["drop"])
        out = []
        for c in df.columns:
            if c in drop:
                continue
            if c in st["fill"] and st["fill"][c] is not None:
                fill, kind = st["fill"][c], df.schema[c].dataType.typeName()
                # an integer column with missing values is a double column: its median may lie between two
                to = "double" if kind in ("byte", "short", "integer", "long") and isinstance(fill, float) else df.schema[c].dataType
                out.append(F.coalesce(qcol(c).cast(to), F.lit(fill).cast(to)).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)


# ------------------------------------------------------------------ T8/T9 outlier capping

class OutlierCapper(TabEstimator):
    """T8 (iqr: Q1−3·IQR, Q3+3·IQR, exact quartiles) / T9 (zscore: mean ± 5·sample std).
    Nulls stay null (``greatest(null, x)`` would otherwise return x)."""

    defaults = {"method": "iqr", "iqr": S.outlier_iqr, "z": S.outlier_z, "quantile_method": "exact",
                "cols": None}

    def _fit(self, df: DataFrame) -> "OutlierCapperModel":
        o = self.opts
        cols = o["cols"] or numeric_columns(df)
        st = column_stats(df, cols)
        bounds = {}
        if o["method"] == "iqr":
            qs = quantiles(df, cols, [0.25, 0.75], method=o["quantile_method"], counts={c: st[c]["n"] for c in cols})
            for c in cols:
                q1, q3 = qs[c][0.25], qs[c][0.75]
                if q1 is None:
                    continue
                bounds[c] = [q1 - o["iqr"] * (q3 - q1), q3 + o["iqr"] * (q3 - q1)]
        else:
            for c in cols:
                if st[c]["mean"] is None or st[c]["std"] is None:
                    continue
                bounds[c] = [st[c]["mean"] - o["z"] * st[c]["std"], st[c]["mean"] + o["z"] * st[c]["std"]]
        return OutlierCapperModel(state={"bounds": bounds})


class OutlierCapperModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        b = self.st["bounds"]
        out = []
        for c in df.columns:
            if c in b:
                x = qcol(c)
                out.append(F.when(x.isNull(), x).otherwise(
                    F.greatest(F.least(x.cast("double"), F.lit(b[c][1])), F.lit(b[c][0]))).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)


# ------------------------------------------------------------------ T10 constants

class ConstantRemover(TabEstimator):
    """Drop columns with ≤ 1 distinct value, or numeric with sample std < 1e-10."""

    defaults = {"min_variance": S.min_variance}

    def _fit(self, df: DataFrame) -> "DropColumnsModel":
        dc = {r["column"]: r["n_distinct"] for r in distinct_counts(frequency_table(df, df.columns)).collect()}
        num = numeric_columns(df)
        st = column_stats(df, num)
        drop = []
        for c in df.columns:
            if dc.get(c, 0) <= 1:
                drop.append(c)
            elif c in st and st[c]["std"] is not None and st[c]["std"] < self.opts["min_variance"]:
                drop.append(c)
        return DropColumnsModel(state={"drop": drop})


class DropColumnsModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.st["drop"] if c in df.columns])


# ------------------------------------------------------------------ T11 high cardinality

class HighCardinalityRemover(TabEstimator):
    """String columns with > 50 distinct values at fit are dropped when
    distinct/rows ≥ 0.5 (an identifier), kept otherwise. Decided at fit and frozen."""

    defaults = {"max_categories": S.max_categories_ohe, "id_ratio": 0.5}

    def _fit(self, df: DataFrame) -> "DropColumnsModel":
        cols = string_columns(df)
        n = df.count()
        dc = {r["column"]: r["n_distinct"] for r in distinct_counts(frequency_table(df, cols)).collect()} if cols else {}
        drop = [c for c in cols if dc.get(c, 0) > self.opts["max_categories"] and n and dc[c] / n >= self.opts["id_ratio"]]
        return DropColumnsModel(state={"drop": drop})


# ------------------------------------------------------------------ T12 type conversion

class TypeConverter(TabEstimator):
    """String columns whose every non-null value is a number become double
    (unparseable values later → null); other strings stay strings; ``null_as_text``
    writes null as 'nan' the way a string cast of a missing value does."""

    defaults = {"null_as_text": False}

    def _fit(self, df: DataFrame) -> "TypeConverterModel":
        cols = string_columns(df)
        numeric = []
        if cols:
            per = {c: {"bad": F.count_if(qcol(c).isNotNull() & ~parses_as_number(qcol(c))).cast("long")} for c in cols}
            numeric = [r["column"] for r in one_row_long(df, per).collect() if r["bad"] == 0]
        return TypeConverterModel(state={"numeric": numeric, "text": [c for c in cols if c not in numeric]},
                                  options=self.opts)


class TypeConverterModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st, o = self.st, self.opts
        out = []
        for c in df.columns:
            if c in st["numeric"]:
                v = strip_ws(qcol(c).cast("string"))
                out.append(F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double")).alias(c))
            elif c in st["text"] and o.get("null_as_text"):
                out.append(F.coalesce(qcol(c), F.lit("nan")).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)


# ------------------------------------------------------------------ T13 rare categories

class RareCategoryCollapser(TabEstimator):
    """Values below 1 % of a string column's non-null values become 'Other'.
    At most 1/threshold values can be kept per column, so the frozen keep-list is
    bounded (≤ 100 literals per column) whatever the data size."""

    defaults = {"threshold": S.rare_category_threshold, "other": "Other"}

    def _fit(self, df: DataFrame) -> "RareCategoryModel":
        cols = string_columns(df)
        if not cols:
            return RareCategoryModel(state={"keep": {}, "collapse": []}, options=self.opts)
        often, totals = frequent_values(df, cols, self.opts["threshold"])
        rows = often.collect()
        held = {c: [r for r in rows if r["column"] == c] for c in cols}
        keep = {c: sorted(r["value"] for r in held[c]) for c in cols if sum(r["n"] for r in held[c]) < totals[c]}
        return RareCategoryModel(state={"keep": keep}, options=self.opts)


class RareCategoryModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        keep, other = self.st["keep"], self.opts.get("other", "Other")
        out = []
        for c in df.columns:
            if c in keep:
                x = qcol(c)
                out.append(F.when(x.isNull() | x.isin(keep[c]), x).otherwise(F.lit(other)).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)
