"""Preprocessing plan assembly (T25) and fit/transform.

The plan is decided on the driver from the profile (small facts), then fitted as
one ``pyspark.ml.Pipeline``; every fitted stage is a projection, so the fitted
``PipelineModel`` scores batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS, Settings
from tabprep.functions.exprs import numeric_columns
from tabprep.operators import clean as CL
from tabprep.operators import encode as EN
from tabprep.operators import profile as P


def profile_facts(df: DataFrame, target: str, s: Settings = DEFAULT_SETTINGS) -> dict:
    """The profile facts the plan reads: any missing value, low-variance and
    high-cardinality columns (the profile includes the target column), task."""
    n = df.count()
    card = P.cardinality(df, None, n)
    card = df.sparkSession.createDataFrame(card.collect(), card.schema)  # one row a column, read twice
    miss = P.missing(df).agg(F.sum("n_missing")).first()[0] or 0
    low = [r["column"] for r in P.low_variance(card).collect()]
    high = [r["column"] for r in P.high_cardinality(card, s).collect()]
    task = P.infer_task(df, target, s=s)
    return {"any_missing": miss > 0, "low_variance": low, "high_cardinality": high, "task": task}


def build_pipeline(facts: dict, n_features: int, s: Settings = DEFAULT_SETTINGS, scaler: str = "standard",
                   impute: str = "auto", encoding: str = "auto") -> Pipeline:
    """Imputer if anything is missing → constant remover if low variance was
    found → high-cardinality remover if found → rare collapser → type converter →
    IQR capping for regression → categorical encoder → scaler → squares when
    enabled and at most 20 features."""
    stages = []
    if facts["any_missing"]:
        stages.append(CL.MissingValueImputer(strategy=impute))
    if facts["low_variance"]:
        stages.append(CL.ConstantRemover())
    if facts["high_cardinality"]:
        stages.append(CL.HighCardinalityRemover())
    stages.append(CL.RareCategoryCollapser())
    stages.append(CL.TypeConverter())
    if facts["task"] == "regression":
        stages.append(CL.OutlierCapper(method="iqr"))
    stages.append(EN.CategoricalEncoder(mode="ordinal" if encoding == "ordinal" else "auto"))
    stages.append(EN.NumericScaler(method=scaler))
    if s.feature_engineering and n_features <= 20:
        stages.append(EN.FeatureEngineer(polynomials=True, interactions=False))
    return Pipeline(stages=stages)


def fit_transform(pipeline: Pipeline, features: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Fit on the feature columns, return the fitted model and the transformed table."""
    model = pipeline.fit(features)
    return model, model.transform(features)


def stage_names(pipeline: Pipeline) -> list[str]:
    return [type(st).__name__ for st in pipeline.getStages()]
