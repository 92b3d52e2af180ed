"""Encoding, scaling and feature construction stages T14–T24.

Decisions: the one-hot vocabulary is the sorted distinct values and the first
sorted value is dropped (so no category collapses); unseen values get all-zero
indicators or the reserved code ``len(vocabulary)``; every decision is frozen at
fit, so one-row scoring gives the same schema as training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS
from tabprep.functions.exprs import numeric_columns, qcol, string_columns
from tabprep.functions.freq import column_stats, distinct_counts, frequency_table
from tabprep.functions.lookup import (
    LITERAL_LIMIT, dense_index, join_lookup, literal_lookup, read_table, store_table)
from tabprep.functions.quantile import quantiles
from tabprep.operators.base import TabEstimator, TabModel

S = DEFAULT_SETTINGS
MISSING = "missing"


def _vocabularies(df: DataFrame, cols: list[str]) -> tuple[dict[str, int], dict[str, bool], DataFrame]:
    freq = frequency_table(df, cols)
    dc = {r["column"]: r["n_distinct"] for r in distinct_counts(freq).collect()}
    nulls = df.agg(*[F.count_if(qcol(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    has_null = {c: nulls[f"n{i}"] > 0 for i, c in enumerate(cols)}
    return {c: dc.get(c, 0) for c in cols}, has_null, freq


class CategoricalEncoder(TabEstimator):
    """T14–T17. Per string column, by distinct count at fit:
    2 → binary code by sorted order; ≤ 50 (or ≤ 1) → one-hot, first sorted value
    dropped, columns ``<col>_<value>``; > 50 → ordinal code by sorted order.
    Codes: null → the code of 'missing' (present when nulls were seen at fit),
    unseen → 'missing' code or the reserved ``len(vocabulary)``.
    ``mode='ordinal'`` codes every string column (T17)."""

    defaults = {"max_categories": S.max_categories_ohe, "mode": "auto"}

    def _fit(self, df: DataFrame) -> "CategoricalEncoderModel":
        cols = string_columns(df)
        if not cols:
            return CategoricalEncoderModel(state={"plan": {}})
        dc, has_null, freq = _vocabularies(df, cols)
        plan = {}
        small = [c for c in cols if dc[c] <= LITERAL_LIMIT]
        vocab_small = {}
        if small:
            for r in freq.where(F.col("column").isin(small)).groupBy("column") \
                         .agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
                vocab_small[r["column"]] = r["v"]
        big = [c for c in cols if c not in small]
        for c in cols:
            kind = "ordinal" if self.opts["mode"] == "ordinal" else (
                "binary" if dc[c] == 2 else ("onehot" if dc[c] <= self.opts["max_categories"] else "ordinal"))
            if kind == "onehot":
                plan[c] = {"kind": "onehot", "values": vocab_small.get(c, [])[1:]}
                continue
            extra = [MISSING] if has_null[c] else []
            if c in vocab_small:
                vocab = sorted(set(vocab_small[c]) | set(extra))
                plan[c] = {"kind": kind, "codes": {v: i for i, v in enumerate(vocab)}, "size": len(vocab)}
        if big:
            vals = freq.where(F.col("column").isin(big)).select("column", "value")
            extra_rows = [(c, MISSING) for c in big if has_null[c]]
            if extra_rows:
                vals = vals.unionByName(df.sparkSession.createDataFrame(extra_rows, "column string, value string")).distinct()
            idx = dense_index(vals)
            path = store_table(idx, "tabprep-vocab")
            sizes = {r["column"]: r["n"] for r in read_table(df.sparkSession, path).groupBy("column")
                     .agg(F.count(F.lit(1)).alias("n")).collect()}
            miss = {r["column"]: r["idx"] for r in read_table(df.sparkSession, path)
                    .where(F.col("value") == MISSING).select("column", "idx").collect()}
            for c in big:
                plan[c] = {"kind": "ordinal", "path": path, "size": sizes[c], "missing_code": miss.get(c)}
        return CategoricalEncoderModel(state={"plan": plan})


INDICATOR = {"indicator": True}


class CategoricalEncoderModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        plan = self.st["plan"]
        out, joins = [], []
        for c in df.columns:
            p = plan.get(c)
            if p is None:
                out.append(qcol(c))
            elif p["kind"] == "onehot":
                for v in p["values"]:
                    out.append(F.coalesce((qcol(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}", metadata=INDICATOR))
            elif "codes" in p:
                codes = p["codes"]
                unseen = codes.get(MISSING, p["size"])
                key = F.coalesce(qcol(c), F.lit(MISSING))
                out.append(literal_lookup(key, codes, unseen).cast("long").alias(c))
            else:
                out.append(qcol(c))
                joins.append((c, p))
        res = df.select(*out)
        for c, p in joins:
            table = read_table(df.sparkSession, p["path"]).where(F.col("column") == c) \
                .select(F.col("value").alias("key"), "idx")
            unseen = p["missing_code"] if p.get("missing_code") is not None else p["size"]
            res = join_lookup(res, F.coalesce(qcol(c), F.lit(MISSING)), table, "idx", f"_code_{c}")
            res = res.withColumn(c, F.coalesce(F.col(f"_code_{c}"), F.lit(unseen)).cast("long")).drop(f"_code_{c}")
        return res


def _measures(df: DataFrame) -> list[str]:
    """Numeric columns but for one-hot indicators, which are neither scaled nor squared."""
    return [c for c in numeric_columns(df) if not df.schema[c].metadata.get("indicator")]


class NumericScaler(TabEstimator):
    """T18–T20. standard: (x − mean)/population std (0 → 1); minmax: (x − min)/(max − min)
    (0 range → 0); robust: (x − median)/IQR (0 → 1), exact quartiles."""

    defaults = {"method": "standard", "cols": None, "quantile_method": "exact"}

    def _fit(self, df: DataFrame) -> "NumericScalerModel":
        o = self.opts
        cols = o["cols"] if o["cols"] is not None else _measures(df)
        st = column_stats(df, cols)
        params = {}
        if o["method"] == "standard":
            for c in cols:
                sd = st[c]["std_pop"]
                params[c] = [st[c]["mean"], sd if sd else 1.0]
        elif o["method"] == "minmax":
            for c in cols:
                rng = (st[c]["max"] - st[c]["min"]) if st[c]["max"] is not None else None
                params[c] = [st[c]["min"], rng if rng else 1.0]
        elif o["method"] == "robust":
            qs = quantiles(df, cols, [0.25, 0.5, 0.75], method=o["quantile_method"], counts={c: st[c]["n"] for c in cols})
            for c in cols:
                q = qs[c]
                iqr = (q[0.75] - q[0.25]) if q[0.25] is not None else None
                params[c] = [q[0.5], iqr if iqr else 1.0]
        else:
            raise ValueError(f"Unknown scaling method: {o['method']}")
        return NumericScalerModel(state={"params": params})


class NumericScalerModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.st["params"]
        out = []
        for c in df.columns:
            if c in p and p[c][0] is not None:
                out.append(((qcol(c).cast("double") - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)


class FeatureEngineer(TabEstimator):
    """Ratios a/b (b = 0 → 1e-10) of the first 5 numeric columns against the
    next ones up to position 6, only with ≤ 10 numeric columns; T22: squares of the
    first 10 numeric columns, only with ≤ 20 numeric columns (and at least 2)."""

    defaults = {"interactions": False, "polynomials": True, "cols": None}

    def _fit(self, df: DataFrame) -> "FeatureEngineerModel":
        cols = self.opts["cols"] if self.opts["cols"] is not None else _measures(df)
        return FeatureEngineerModel(state={"cols": cols}, options=self.opts)


class FeatureEngineerModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        cols, o = self.st["cols"], self.opts
        extra = []
        if len(cols) >= 2:
            if o.get("interactions") and len(cols) <= 10:
                for i, a in enumerate(cols[:5]):
                    for b in cols[i + 1:6]:
                        den = F.when(qcol(b) == 0, F.lit(1e-10)).otherwise(qcol(b).cast("double"))
                        extra.append((qcol(a).cast("double") / den).alias(f"{a}_div_{b}"))
            if o.get("polynomials") and len(cols) <= 20:
                for a in cols[:10]:
                    extra.append((qcol(a).cast("double") * qcol(a).cast("double")).alias(f"{a}_squared"))
        return df.select("*", *extra)


class TargetEncoder(TabEstimator):
    """Per category (n·mean + m·global)/(n + m), m = smoothing; null/unseen → global.
    One grouped aggregate over the long form for all string columns."""

    defaults = {"label": "label", "smoothing": 1.0, "cols": None}

    def _fit(self, df: DataFrame) -> "TargetEncoderModel":
        o = self.opts
        cols = o["cols"] if o["cols"] is not None else [c for c in string_columns(df) if c != o["label"]]
        y = qcol(o["label"]).cast("double")
        g = df.agg(F.avg(y)).first()[0]
        if not cols:
            return TargetEncoderModel(state={"global": g, "maps": {}}, options=o)
        long = df.select(y.alias("_y"), *[qcol(c).cast("string").alias(c) for c in cols]) \
                 .unpivot(["_y"], cols, "column", "value").where(F.col("value").isNotNull())
        m = o["smoothing"]
        stats = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mu")) \
                    .select("column", "value", ((F.col("n") * F.col("mu") + F.lit(m * g)) / (F.col("n") + F.lit(m))).alias("enc"))
        sizes = {r["column"]: r["n"] for r in stats.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        maps, paths = {}, {}
        small = [c for c in cols if sizes.get(c, 0) <= LITERAL_LIMIT]
        for r in stats.where(F.col("column").isin(small)).collect():
            maps.setdefault(r["column"], {})[r["value"]] = r["enc"]
        big = [c for c in cols if c not in small]
        if big:
            path = store_table(stats.where(F.col("column").isin(big)), "tabprep-target-enc")
            paths = {c: [path, sizes[c]] for c in big}
        return TargetEncoderModel(state={"global": g, "maps": {c: maps.get(c, {}) for c in small}, "paths": paths},
                                  options=o)


class TargetEncoderModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        g = st["global"]
        out = []
        for c in df.columns:
            if c in st["maps"]:
                out.append(literal_lookup(qcol(c), st["maps"][c], g).cast("double").alias(c))
            else:
                out.append(qcol(c))
        res = df.select(*out)
        for c, (path, n) in st.get("paths", {}).items():
            t = read_table(df.sparkSession, path).where(F.col("column") == c).select(F.col("value").alias("key"), "enc")
            res = join_lookup(res, qcol(c), t, "enc", f"_enc_{c}")
            res = res.withColumn(c, F.coalesce(F.col(f"_enc_{c}"), F.lit(g))).drop(f"_enc_{c}")
        return res


class LabelIndexer(TabEstimator):
    """Target classes → 0..k−1 by sorted order; ``decode`` maps codes back. Up to LITERAL_LIMIT
    classes are literals, more are a table in the shared folder."""

    defaults = {"input": "label", "output": "label_idx"}

    def _fit(self, df: DataFrame) -> "LabelIndexerModel":
        c = self.opts["input"]
        classes = [r[0] for r in df.where(qcol(c).isNotNull()).select(qcol(c).cast("string")).distinct()
                   .orderBy(1).limit(LITERAL_LIMIT + 1).collect()]
        if len(classes) > LITERAL_LIMIT:
            every = df.where(qcol(c).isNotNull()).select(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")).distinct()
            return LabelIndexerModel(state={"path": store_table(dense_index(every), "tabprep-classes")}, options=self.opts)
        return LabelIndexerModel(state={"classes": classes}, options=self.opts)


class LabelIndexerModel(TabModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        o = self.opts
        if "path" in self.st:
            t = read_table(df.sparkSession, self.st["path"]).select(F.col("value").alias("key"), F.col("idx").cast("double").alias("idx"))
            return join_lookup(df, qcol(o["input"]).cast("string"), t, "idx", o["output"])
        classes = self.st["classes"]
        code = literal_lookup(qcol(o["input"]).cast("string"), {v: i for i, v in enumerate(classes)})
        return df.withColumn(o["output"], code.cast("double"))

    def decode(self, df: DataFrame, code: str, out: str) -> DataFrame:
        """df with ``out`` = the class of each code."""
        if "path" in self.st:
            t = read_table(df.sparkSession, self.st["path"]).select(F.col("idx").alias("key"), "value")
            return join_lookup(df, qcol(code).cast("long"), t, "value", out)
        return df.withColumn(out, self.inverse(qcol(code)))

    def inverse(self, c) -> "F.Column":
        """The class of a code as an expression; for at most LITERAL_LIMIT classes."""
        classes = self.st["classes"]
        return literal_lookup(c.cast("int"), {i: v for i, v in enumerate(classes)})
