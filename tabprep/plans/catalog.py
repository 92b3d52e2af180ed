"""The query catalogue: one callable per inventory ID, each ``(spark, sf_dir) -> DataFrame``.

Every entry runs the library operator over whole driver tables (or whole
tables derived from them in SQL). Floating outputs are rounded to 6 places so
that a result does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS
from tabprep.functions.exprs import numeric_columns, string_columns
from tabprep.functions.freq import frequency_table, top_values
from tabprep.operators import profile as P
from tabprep.plans import file_queries
from tabprep.plans.inputs import table
from tabprep.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        CATALOG[name] = fn
        return fn
    return deco


def rnd(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every double column (or ``cols``) to ``digits`` places."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


DL_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_rebate", "l_gross"]

# ---------------------------------------------------------------- profiling


@query("p02_basic")
def p02_basic(spark, sf):
    return P.basic(table(spark, sf, "dl"))


@query("p03_missing")
def p03_missing(spark, sf):
    return P.missing(table(spark, sf, "dl"))


@query("p04_missing_flags")
def p04_missing_flags(spark, sf):
    return P.missing_flags(P.missing(table(spark, sf, "dl")))


@query("p05_sparse_rows")
def p05_sparse_rows(spark, sf):
    return P.sparse_rows(table(spark, sf, "dl"))


@query("p08_cardinality")
def p08_cardinality(spark, sf):
    return P.cardinality(table(spark, sf, "customer")).select("column", "n_distinct", "ratio")


@query("p09_id_columns")
def p09_id_columns(spark, sf):
    return P.id_columns(P.cardinality(table(spark, sf, "customer")))


@query("p10_high_cardinality")
def p10_high_cardinality(spark, sf):
    return P.high_cardinality(P.cardinality(table(spark, sf, "customer")))


@query("p11_low_variance")
def p11_low_variance(spark, sf):
    return P.low_variance(P.cardinality(table(spark, sf, "dl")))


@query("p12_duplicates")
def p12_duplicates(spark, sf):
    return P.duplicates(table(spark, sf, "dl_dup"))


def _events_outliers(spark, sf):
    ev = table(spark, sf, "events")
    return P.outliers(ev, cols=["event_id", "user_id", "value"])


@query("p13_zscore_outliers")
def p13_zscore_outliers(spark, sf):
    return _events_outliers(spark, sf).select("column", "n", "z_outliers")


@query("p14_iqr_outliers")
def p14_iqr_outliers(spark, sf):
    ev = table(spark, sf, "events")
    cols = ["event_id", "user_id", "value"]
    fit = P.fit_numeric(ev, cols, (0.25, 0.75))
    out = P.outliers(ev, fit=fit, cols=cols).select("column", "iqr_outliers")
    q = spark.createDataFrame([(c, fit.q[c][0.25], fit.q[c][0.75]) for c in cols],
                              "column string, q1 double, q3 double")
    return rnd(out.join(q, "column"))


@query("p15_numeric_stats")
def p15_numeric_stats(spark, sf):
    return rnd(_events_outliers(spark, sf).select("column", "min", "max", "mean", "std"))


@query("p16_outlier_rules")
def p16_outlier_rules(spark, sf):
    cx = table(spark, sf, "cust_x")
    return rnd(P.outlier_rules(P.outliers(cx, cols=["c_acctbal", "age", "c_bonus"])))


@query("p17_numeric_summary")
def p17_numeric_summary(spark, sf):
    return rnd(P.numeric_summary(table(spark, sf, "dl"), cols=DL_NUMERIC))


@query("p18_string_summary")
def p18_string_summary(spark, sf):
    summary, _ = P.string_summary(table(spark, sf, "events").select("event_type", "props"))
    return summary


@query("p18_top_values")
def p18_top_values(spark, sf):
    _, top = P.string_summary(table(spark, sf, "events").select("event_type", "props"))
    return top


@query("p19_correlation")
def p19_correlation(spark, sf):
    return rnd(P.correlations(table(spark, sf, "dl"), cols=DL_NUMERIC))


@query("p20_high_correlation")
def p20_high_correlation(spark, sf):
    dl = table(spark, sf, "dl")
    return P.high_correlations(P.correlations(dl, cols=numeric_columns(dl)))


@query("p21_target_profile")
def p21_target_profile(spark, sf):
    return P.target_profile(table(spark, sf, "dl"), "l_returnflag")


@query("p22_task_type")
def p22_task_type(spark, sf):
    return P.target_profile(table(spark, sf, "part"), "p_retailprice")


@query("p23_class_distribution")
def p23_class_distribution(spark, sf):
    return P.class_distribution(table(spark, sf, "labels"), "quality")


@query("p24_class_balance")
def p24_class_balance(spark, sf):
    return P.class_balance(P.class_distribution(table(spark, sf, "labels"), "quality"))


@query("p26_regression_target")
def p26_regression_target(spark, sf):
    return rnd(P.regression_target(table(spark, sf, "part"), "p_retailprice"))


@query("p27_leakage")
def p27_leakage(spark, sf):
    return P.leakage(table(spark, sf, "cust_x"), "c_acctbal")


@query("p29_findings")
def p29_findings(spark, sf):
    return rnd(P.findings(table(spark, sf, "dl"), target="l_returnflag"))


# ---------------------------------------------------------------- post-read cleanup, repair

from tabprep.sources import cleanup as C  # noqa: E402
from tabprep.operators import repair as V  # noqa: E402


@query("s07_na_tokens")
def s07_na_tokens(spark, sf):
    return P.missing(C.na_tokens_to_null(table(spark, sf, "raw_li")))


@query("s14_repeated_headers")
def s14_repeated_headers(spark, sf):
    raw = table(spark, sf, "raw_li_hdr")
    hdr = C.is_header_row(raw)
    return raw.agg(F.count_if(~hdr).cast("long").alias("n_rows"), F.count_if(hdr).cast("long").alias("n_header_rows"))


@query("s11_drop_empty_rows")
def s11_drop_empty_rows(spark, sf):
    t = C.drop_empty_rows(C.na_tokens_to_null(C.drop_repeated_headers(table(spark, sf, "raw_li_hdr"))))
    return t.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


@query("s08_type_inference")
def s08_type_inference(spark, sf):
    _, decisions = C.cleanup(table(spark, sf, "raw_li_hdr"))
    return decisions


@query("s16_ingest_cleanup")
def s16_ingest_cleanup(spark, sf):
    typed, _ = C.cleanup(table(spark, sf, "raw_li_hdr"))
    return typed


@query("p06_semantic_types")
def p06_semantic_types(spark, sf):
    return P.semantic_types(C.na_tokens_to_null(table(spark, sf, "raw_li")))


def _clean_li(spark, sf):
    typed, _ = C.cleanup(table(spark, sf, "raw_li_hdr"))
    return typed


@query("v06_repair_decisions")
def v06_repair_decisions(spark, sf):
    return V.repair_decisions(_clean_li(spark, sf))


@query("v06_repair_units_ok")
def v06_repair_units_ok(spark, sf):
    return V.repair_decisions(_clean_li(spark, sf), units_ok=True)


@query("v03_repaired_table")
def v03_repaired_table(spark, sf):
    repaired, _ = V.repair_columns(_clean_li(spark, sf))
    return repaired


# ---------------------------------------------------------------- EDA

from tabprep.operators import eda as E  # noqa: E402
from tabprep.operators import prepare as T  # noqa: E402
from tabprep.operators import clean as CL  # noqa: E402
from tabprep.operators import encode as EN  # noqa: E402


@query("e01_feasibility")
def e01_feasibility(spark, sf):
    return E.feasibility(table(spark, sf, "benchmark"))


@query("e02_dimensionality")
def e02_dimensionality(spark, sf):
    return E.dimensionality(table(spark, sf, "benchmark"))


@query("e03_outliers_iqr15")
def e03_outliers_iqr15(spark, sf):
    return E.iqr_outlier_counts(table(spark, sf, "events"), cols=["event_id", "user_id", "value"])


@query("e03_outlier_issue")
def e03_outlier_issue(spark, sf):
    docs = table(spark, sf, "documents")
    return E.outlier_issue(E.iqr_outlier_counts(docs))


@query("e04_imbalance")
def e04_imbalance(spark, sf):
    return E.imbalance(table(spark, sf, "labels"), "quality")


@query("e05_missing_table")
def e05_missing_table(spark, sf):
    return E.missing_table(table(spark, sf, "dl"))


@query("e06_histogram")
def e06_histogram(spark, sf):
    return rnd(E.histogram(table(spark, sf, "events"), cols=["user_id", "value"]))


@query("e07_top_values")
def e07_top_values(spark, sf):
    o = table(spark, sf, "orders")
    return top_values(frequency_table(o, ["o_orderstatus", "o_orderpriority"]), 10) \
        .withColumn("rank", F.col("rank").cast("int"))


@query("e08_missing_advice")
def e08_missing_advice(spark, sf):
    return E.missing_advice(table(spark, sf, "dl"), threshold=50.0)


@query("e09_apply_decisions")
def e09_apply_decisions(spark, sf):
    dl = table(spark, sf, "dl")
    advice = {r["column"]: r["action"] for r in E.missing_advice(dl).collect()}
    advice["l_tax"] = "drop_rows"
    return E.apply_missing_decisions(dl, advice)


@query("e10_input_ranges")
def e10_input_ranges(spark, sf):
    return rnd(E.input_ranges(table(spark, sf, "part")))


@query("e10_category_domains")
def e10_category_domains(spark, sf):
    return E.category_domains(table(spark, sf, "part"), ["p_brand", "p_type"])


# ---------------------------------------------------------------- preparation and cleaning


@query("t01_drop_null_target")
def t01_drop_null_target(spark, sf):
    return T.drop_null_target(table(spark, sf, "dl"), "l_returnflag")


@query("t02_drop_duplicates")
def t02_drop_duplicates(spark, sf):
    return T.drop_duplicate_rows(table(spark, sf, "dl_dup"))


@query("t04_prepare_data")
def t04_prepare_data(spark, sf):
    prepared, _ = T.prepare_data(table(spark, sf, "cust_x"), "c_mktsegment")
    return prepared


@query("t06_impute")
def t06_impute(spark, sf):
    dl = table(spark, sf, "dl")
    return rnd(CL.MissingValueImputer().fit(dl).transform(dl))


@query("t07_impute_mean")
def t07_impute_mean(spark, sf):
    dl = table(spark, sf, "dl")
    return rnd(CL.MissingValueImputer(strategy="mean").fit(dl).transform(dl))


@query("t08_cap_iqr")
def t08_cap_iqr(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return rnd(CL.OutlierCapper(method="iqr", cols=["value"]).fit(ev).transform(ev))


@query("t09_cap_zscore")
def t09_cap_zscore(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return rnd(CL.OutlierCapper(method="zscore", cols=["n_chars"]).fit(docs).transform(docs))


@query("t10_drop_constants")
def t10_drop_constants(spark, sf):
    t = table(spark, sf, "dl_c")
    return CL.ConstantRemover().fit(t).transform(t)


@query("t11_high_cardinality")
def t11_high_cardinality(spark, sf):
    t = table(spark, sf, "customer")
    return CL.HighCardinalityRemover().fit(t).transform(t)


@query("t12_type_convert")
def t12_type_convert(spark, sf):
    t = C.na_tokens_to_null(table(spark, sf, "raw_li"))
    return CL.TypeConverter(null_as_text=True).fit(t).transform(t)


@query("t13_rare_categories")
def t13_rare_categories(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type", "props")
    return CL.RareCategoryCollapser().fit(t).transform(t)


# ---------------------------------------------------------------- encoding and scaling


@query("t14_binary_encode")
def t14_binary_encode(spark, sf):
    t = table(spark, sf, "dl").select("l_orderkey", "l_linenumber", "l_linestatus")
    return EN.CategoricalEncoder().fit(t).transform(t)


@query("t15_onehot_encode")
def t15_onehot_encode(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return EN.CategoricalEncoder().fit(t).transform(t)


@query("t16_ordinal_encode")
def t16_ordinal_encode(spark, sf):
    # c_name has more distinct values than a literal map takes: dense index + join
    t = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return EN.CategoricalEncoder().fit(t).transform(t)


@query("t16_ordinal_small")
def t16_ordinal_small(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return EN.CategoricalEncoder().fit(t).transform(t)


@query("t17_ordinal_all")
def t17_ordinal_all(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return EN.CategoricalEncoder(mode="ordinal").fit(t).transform(t)


def _scaled(spark, sf, method):
    t = table(spark, sf, "dl").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_gross")
    cols = ["l_quantity", "l_discount", "l_gross"]
    return rnd(EN.NumericScaler(method=method, cols=cols).fit(t).transform(t))


@query("t18_scale_standard")
def t18_scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("t19_scale_minmax")
def t19_scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("t20_scale_robust")
def t20_scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("t21_ratio_features")
def t21_ratio_features(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rnd(EN.FeatureEngineer(interactions=True, polynomials=False).fit(t).transform(t))


@query("t22_square_features")
def t22_square_features(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rnd(EN.FeatureEngineer(interactions=False, polynomials=True).fit(t).transform(t))


@query("t23_target_encode")
def t23_target_encode(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return rnd(EN.TargetEncoder(label="p_retailprice").fit(t).transform(t))


@query("t24_label_encode")
def t24_label_encode(spark, sf):
    t = table(spark, sf, "dl").select("l_orderkey", "l_linenumber", "l_returnflag")
    m = EN.LabelIndexer(input="l_returnflag", output="label_idx").fit(t)
    out = m.transform(t)
    return out.withColumn("label_back", m.inverse(F.col("label_idx")))


# ---------------------------------------------------------------- split and folds

from tabprep.operators import split as M  # noqa: E402
from tabprep.operators import evaluate as X  # noqa: E402
from tabprep.operators import learners as L  # noqa: E402


def _li_key():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


@query("m01_row_cap")
def m01_row_cap(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.row_cap(li, _li_key(), 5000).select("l_orderkey", "l_linenumber")


@query("m02_matrix_check")
def m02_matrix_check(spark, sf):
    dl = table(spark, sf, "dl")
    return M.matrix_check(dl, DL_NUMERIC + ["l_returnflag"])


@query("m03_split_hash")
def m03_split_hash(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.train_test_split(li, _li_key()).select("l_orderkey", "l_linenumber", "is_test")


@query("m03_split_exact")
def m03_split_exact(spark, sf):
    lab = table(spark, sf, "labels")
    return M.train_test_split(lab, F.col("doc_id"), label="quality", method="exact").select("doc_id", "is_test")


@query("m04_stratified_folds")
def m04_stratified_folds(spark, sf):
    lab = table(spark, sf, "labels")
    return M.fold_ids(lab, F.col("doc_id"), label="quality", k=3, method="stratified").select("doc_id", "fold")


@query("m05_kfold_hash")
def m05_kfold_hash(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.fold_ids(li, _li_key(), k=3).select("l_orderkey", "l_linenumber", "fold")


# ---------------------------------------------------------------- evaluation


@query("x01_accuracy")
def x01_accuracy(spark, sf):
    return X.accuracy(table(spark, sf, "scored_mc"))


@query("x02_weighted_prf")
def x02_weighted_prf(spark, sf):
    return X.weighted_prf(table(spark, sf, "scored_mc"))


@query("x03_roc_auc")
def x03_roc_auc(spark, sf):
    return X.roc_auc(table(spark, sf, "scored"))


@query("x04_regression_metrics")
def x04_regression_metrics(spark, sf):
    return X.regression_metrics(table(spark, sf, "scored_reg"))


@query("x05_confusion_matrix")
def x05_confusion_matrix(spark, sf):
    return X.confusion_matrix(table(spark, sf, "scored_mc"))


@query("x06_roc_curve")
def x06_roc_curve(spark, sf):
    return rnd(X.roc_curve(table(spark, sf, "scored")))


@query("x06_roc_area")
def x06_roc_area(spark, sf):
    return X.roc_area(X.roc_curve(table(spark, sf, "scored")))


# ---------------------------------------------------------------- learners with closed forms


def _li_train_test(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    sp = M.train_test_split(li, _li_key())
    return sp.where(~F.col("is_test")), sp.where(F.col("is_test"))


def _fit_linear(spark, sf, kind, alpha=1.0, l1_ratio=0.5, split=None):
    from pyspark.ml.feature import VectorAssembler
    train, test = split or _li_train_test(spark, sf)
    asm = VectorAssembler(inputCols=["l_quantity"], outputCol="features")
    tr = asm.transform(train).withColumnRenamed("l_extendedprice", "label")
    n, sd = L.label_std(tr)
    model = L.linear_model(kind, n, sd, alpha, l1_ratio).fit(tr)
    return model, asm, test


def _coef(spark, sf, kind, **kw):
    m, _, _ = _fit_linear(spark, sf, kind, **kw)
    return spark.createDataFrame([(kind, float(m.intercept), float(m.coefficients[0]))],
                                 "model string, intercept double, coef double").select(
        "model", F.round("intercept", 3).alias("intercept"), F.round("coef", 3).alias("coef"))


@query("l04_linear_regression")
def l04_linear_regression(spark, sf):
    return _coef(spark, sf, "linear")


@query("l05_ridge")
def l05_ridge(spark, sf):
    return _coef(spark, sf, "ridge", alpha=1000.0)


@query("l06_lasso")
def l06_lasso(spark, sf):
    return _coef(spark, sf, "lasso", alpha=1000.0)


@query("l07_elastic_net")
def l07_elastic_net(spark, sf):
    return _coef(spark, sf, "elastic_net", alpha=1000.0, l1_ratio=0.5)


@query("l01_baseline_majority")
def l01_baseline_majority(spark, sf):
    lab = M.train_test_split(table(spark, sf, "labels"), F.col("doc_id"))
    v = L.majority_class(lab.where(~F.col("is_test")), "quality")
    return X.accuracy(lab.where(F.col("is_test")).select(F.col("quality").alias("label"),
                                                         F.lit(v).alias("prediction"))) \
        .select(F.lit(v).cast("int").alias("majority"), "accuracy")


@query("l02_baseline_mean")
def l02_baseline_mean(spark, sf):
    train, test = _li_train_test(spark, sf)
    v = L.mean_value(train, "l_extendedprice")
    m = X.regression_metrics(test.select(F.col("l_extendedprice").alias("label"), F.lit(v).alias("prediction")))
    return m.select(F.round(F.lit(v), 4).alias("mean"), "rmse", "mae", "r2")


@query("l12_knn")
def l12_knn(spark, sf):
    emb = M.train_test_split(table(spark, sf, "embeddings"), F.col("vec_id"))
    train, test = emb.where(~F.col("is_test")), emb.where(F.col("is_test"))
    return L.knn_predict(train, test, "vec_id", "embedding", "label", k=5).select(
        "vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("l13_gaussian_nb")
def l13_gaussian_nb(spark, sf):
    ev = M.train_test_split(table(spark, sf, "events"), F.col("event_id"))
    model = L.fit_gaussian_nb(ev.where(~F.col("is_test")), ["value", "user_id"], label="event_type")
    return model.transform(ev.where(F.col("is_test"))).select("event_id", "prediction")


# ---------------------------------------------------------------- leaderboard over the closed-form learners


def _regression_board(spark, sf):
    rows = []
    train, test = _li_train_test(spark, sf)
    train, test = train.persist(), test.persist()
    mean = L.mean_value(train, "l_extendedprice")
    base = X.regression_metrics(test.select(F.col("l_extendedprice").alias("label"),
                                            F.lit(mean).alias("prediction"))).first()
    rows.append(("dummy", "ok", 0, base["rmse"], base["mae"], base["r2"]))
    for pos, (kind, kw) in enumerate([("linear", {}), ("ridge", {"alpha": 1000.0}), ("lasso", {"alpha": 1000.0}),
                                      ("elastic_net", {"alpha": 1000.0, "l1_ratio": 0.5})], start=1):
        m, asm, te = _fit_linear(spark, sf, kind, split=(train, test), **kw)
        pred = m.transform(asm.transform(te).withColumnRenamed("l_extendedprice", "label"))
        r = X.regression_metrics(pred).first()
        rows.append((kind, "ok", pos, r["rmse"], r["mae"], r["r2"]))
    train.unpersist()
    test.unpersist()
    return spark.createDataFrame(rows, "model string, status string, position int, test_rmse double, "
                                       "test_mae double, test_r2 double")


@query("m09_leaderboard")
def m09_leaderboard(spark, sf):
    board = X.leaderboard(_regression_board(spark, sf), "regression")
    return board.select("model", F.round("test_rmse", 2).alias("test_rmse"), F.round("test_mae", 2).alias("test_mae"),
                        F.round("test_r2", 3).alias("test_r2"))


@query("m10_best_model")
def m10_best_model(spark, sf):
    return X.best_model(_regression_board(spark, sf), "regression").select(
        "model", F.round("score", 3).alias("score"), F.round("improvement_pct", 1).alias("improvement_pct"))


# ---------------------------------------------------------------- plan assembly and library learners (rows-only)

from tabprep.plans import assemble as A  # noqa: E402
from tabprep.plans import search as SE  # noqa: E402


@query("t25_build_pipeline")
def t25_build_pipeline(spark, sf):
    cx = table(spark, sf, "dl")
    facts = A.profile_facts(cx, "l_returnflag")
    pipe = A.build_pipeline(facts, len(cx.columns) - 1)
    return spark.createDataFrame(list(enumerate(A.stage_names(pipe))), "position int, stage string")


@query("t26_fit_transform")
def t26_fit_transform(spark, sf):
    prepared, _ = T.prepare_data(table(spark, sf, "dl"), "l_returnflag")
    feats = prepared.drop("label")
    facts = A.profile_facts(table(spark, sf, "dl"), "l_returnflag")
    _, out = A.fit_transform(A.build_pipeline(facts, len(feats.columns)), feats)
    return rnd(out)


def _doc_split(spark, sf):
    d = cut_lineage(table(spark, sf, "doc_feats"))  # a few numbers a row: the texts are read once
    d = EN.NumericScaler(cols=["n_chars", "n_dots"]).fit(d).transform(d)
    d = M.fold_ids(M.train_test_split(d, F.col("doc_id")), F.col("doc_id"), label="label", k=3, method="stratified")
    return d.where(~F.col("is_test")), d.where(F.col("is_test"))


DOC_FEATS = ["n_chars", "n_dots", "is_en"]


@query("m08_train_models")
def m08_train_models(spark, sf):
    """M6–M8 + M13: fast-mode learners with random search on stratified folds."""
    train, test = _doc_split(spark, sf)
    board, _ = SE.train_models(train, test, DOC_FEATS, "classification", fast_only=True)
    return X.leaderboard(board, "classification").select("model", "status", "test_accuracy")


def _one_learner(spark, sf, name):
    train, test = _doc_split(spark, sf)
    board, _ = SE.train_models(train, test, DOC_FEATS, "classification", fast_only=False, learners=[name])
    return board.select("model", "status", "test_accuracy")


@query("l03_logistic_regression")
def l03_logistic_regression(spark, sf):
    return _one_learner(spark, sf, "logistic_regression")


@query("l08_decision_tree")
def l08_decision_tree(spark, sf):
    return _one_learner(spark, sf, "decision_tree")


@query("l09_random_forest")
def l09_random_forest(spark, sf):
    return _one_learner(spark, sf, "random_forest")


@query("l10_gradient_boosting")
def l10_gradient_boosting(spark, sf):
    return _one_learner(spark, sf, "gradient_boosting")


@query("l11_adaboost")
def l11_adaboost(spark, sf):
    return _one_learner(spark, sf, "adaboost")


@query("l14_linear_svm")
def l14_linear_svm(spark, sf):
    return _one_learner(spark, sf, "svm")


@query("m12_predict_proba")
def m12_predict_proba(spark, sf):
    """Naive Bayes trained through the search; prediction and probability of each class for the test rows."""
    train, test = _doc_split(spark, sf)
    _, models = SE.train_models(train, test, DOC_FEATS, "classification", learners=["naive_bayes"])
    out = models["naive_bayes"].transform(test)
    return out.select("doc_id", "prediction", F.posexplode("probability").alias("class", "probability"))


@query("x07_importance")
def x07_importance(spark, sf):
    train, test = _doc_split(spark, sf)
    _, models = SE.train_models(train, test, DOC_FEATS, "classification", learners=["decision_tree"])
    return X.feature_importance(spark, models["decision_tree"])


@query("x08_summary")
def x08_summary(spark, sf):
    n_missing = P.missing(table(spark, sf, "dl")).agg(F.sum("n_missing")).first()[0] or 0
    return X.summary(_regression_board(spark, sf), "regression", n_missing).withColumn("score", F.round("score", 3))


# ---------------------------------------------------------------- sources and sinks

from tabprep.sources import files as FS  # noqa: E402
from tabprep.sources import sinks as SK  # noqa: E402


@query("s02_content_sniff")
def s02_content_sniff(spark, sf):
    pages = table(spark, sf, "pages")
    head_hex = F.hex(F.encode(F.substring("html", 1, 8), "UTF-8"))
    return pages.select("page_id", FS.sniff_text(F.col("html")).alias("is_html"),
                        head_hex.startswith(FS.OLE2_MAGIC_HEX).alias("is_ole2"),
                        head_hex.startswith(FS.ZIP_MAGIC_HEX).alias("is_zip"))


@query("s05_delimiter")
def s05_delimiter(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rnd(FS.delimiter_scores(lines, "doc_id"))


def _write_raw_csv(spark, sf) -> str:
    """The raw lineitem table as a ';'-separated file set (one header per part file)
    in the shared checkpoint folder: data Spark derives from the driver's table."""
    import uuid
    from tabprep.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/raw-csv-{uuid.uuid4().hex}"
    (table(spark, sf, "raw_li_hdr").write.mode("overwrite").option("header", True).option("sep", ";")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", "").csv(path))
    return path


@query("s16_ingest_csv")
def s16_ingest_csv(spark, sf):
    """S1–S16 end to end: census, sniff, encoding, delimiter, header names, safe read,
    NA tokens, header repeats, empty rows/columns, type inference, gate."""
    typed, _ = FS.ingest(spark, _write_raw_csv(spark, sf))
    return typed


@query("s01_ingest_findings")
def s01_ingest_findings(spark, sf):
    _, findings = FS.ingest(spark, _write_raw_csv(spark, sf))
    return findings.where(F.col("step") != "census").select("step", "detail")


@query("s19_save_load_model")
def s19_save_load_model(spark, sf):
    """Fit a plan, save it with its metadata, load it back and score."""
    import uuid
    from pyspark.ml import Pipeline
    from tabprep.session import ensure_checkpoint_dir
    dl = table(spark, sf, "dl").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    model = Pipeline(stages=[CL.MissingValueImputer(), EN.CategoricalEncoder(), EN.NumericScaler(
        cols=["l_quantity", "l_discount"])]).fit(dl)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    SK.save_model(model, path, "imputer+encoder+scaler", "classification", dl.columns)
    loaded, meta = SK.load_model(path)
    return rnd(loaded.transform(dl))


@query("s20_report_findings")
def s20_report_findings(spark, sf):
    dl = table(spark, sf, "dl")
    t = SK.report_tables(P.findings(dl, target="l_returnflag"), P.missing(dl),
                         spark.createDataFrame([], "model string"))
    return rnd(t["findings"])


CATALOG.update(file_queries.QUERIES)
