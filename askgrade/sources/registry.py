"""Saved models and the table that lists them."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.operators.linear import LinearModel

_SCHEMA = "name string, path string, params string, cv_score double, kind string, saved_at timestamp"


def _table(root: str) -> str:
    return f"{root.rstrip('/')}/_registry"


def save_model(model: PipelineModel | LinearModel, root: str, name: str, params: dict, cv_score: float) -> str:
    """Save a fitted model under its name and list it in the registry."""
    path = f"{root.rstrip('/')}/{name}"
    kind = "linear" if isinstance(model, LinearModel) else "pipeline"
    if kind == "linear":
        model.save(path)
    else:
        model.write().overwrite().save(path)
    spark = SparkSession.active()
    row = [(name, path, json.dumps(params, sort_keys=True), float(cv_score), kind)]
    entry = spark.createDataFrame(row, "name string, path string, params string, cv_score double, kind string")
    entry.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(_table(root))
    return path


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """The latest entry of every saved model."""
    try:
        saved = spark.read.schema(_SCHEMA).parquet(_table(root))
    except AnalysisException:
        saved = spark.createDataFrame([], _SCHEMA)
    latest = F.max_by(F.struct("path", "params", "cv_score", "kind"), "saved_at").alias("m")
    return saved.groupBy("name").agg(latest).select("name", "m.*")


def load_model(spark: SparkSession, root: str, name: str) -> PipelineModel | LinearModel:
    """Load a model; when it is missing, the error names the models there are."""
    kinds = {r["name"]: r["kind"] for r in list_models(spark, root).select("name", "kind").collect()}
    if name not in kinds:
        raise FileNotFoundError(f"no model {name!r} in {root}; found: {', '.join(sorted(kinds)) or 'none'}")
    path = f"{root.rstrip('/')}/{name}"
    if kinds[name] == "linear":
        return LinearModel.load(spark, path)
    return PipelineModel.load(path)
