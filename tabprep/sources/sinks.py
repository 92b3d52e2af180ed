"""Sinks: leaderboard / report tables (S18, S20) and fitted models."""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Header + comma separated, one folder of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str, name: str, task: str, features: list[str]) -> None:
    """The fitted pipeline plus a small JSON of metadata beside it."""
    from pyspark.sql import SparkSession
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(name, task, json.dumps(features))], "name string, task string, features string") \
         .write.mode("overwrite").json(os.path.join(path, "meta"))


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = PipelineModel.load(os.path.join(path, "model"))
    r = spark.read.json(os.path.join(path, "meta")).first()
    return m, {"name": r["name"], "task": r["task"], "features": json.loads(r["features"])}


def severity(message: F.Column) -> F.Column:
    """Severity class of a message by its prefix words."""
    up = F.upper(message)
    return (F.when(up.contains("CRITICAL"), "critical").when(up.contains("ERROR"), "error")
            .when(up.contains("WARNING"), "warning").otherwise("info"))


def report_tables(findings: DataFrame, missing: DataFrame, leaderboard: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the report: ≤ 10 columns above 50 % missing, ≤ 20 findings
    (most severe first), the leaderboard."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return {
        "high_missing": missing.where(F.col("pct_missing") > 50).orderBy(F.col("pct_missing").desc(), "column").limit(10),
        "findings": findings.withColumn("_o", order).orderBy("_o", "rule", "column").drop("_o").limit(20),
        "leaderboard": leaderboard,
    }
