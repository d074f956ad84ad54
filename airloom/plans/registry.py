"""Stored models: Spark ML folders beside metadata tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators.ordered import first_rows
from airloom.plans.training import best_models
from airloom.sources.tables import METRICS, metrics_scan


class Registry:
    """Models below one folder: ``models/<name>_<h>h``, ``meta`` (one JSON document per save)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def model_path(self, name: str, horizon: int) -> str:
        return f"{self.path}/models/{name}_{horizon}h"

    def save(self, model: PipelineModel, name: str, horizon: int, metrics: dict, features: Sequence[str], at: datetime) -> None:
        path = self.model_path(name, horizon)
        model.write().overwrite().save(path)
        scores = tuple(float(metrics[m]) for m in ("rmse", "mae", "r2"))
        row = [(name, horizon, scores, list(features), at, path)]
        self.spark.createDataFrame(row, METRICS).coalesce(1).write.mode("append").json(f"{self.path}/meta")

    def load(self, name: str, horizon: int) -> PipelineModel:
        return PipelineModel.load(self.model_path(name, horizon))

    def list_models(self) -> DataFrame:
        """Newest metadata per model and horizon."""
        return first_rows(metrics_scan(self.spark, f"{self.path}/meta"), ["model_name", "horizon_hours"], [F.col("trained_at").desc()])

    def best(self) -> DataFrame:
        """Best model per horizon, with its metadata."""
        listed = self.list_models().withColumn("rmse", F.col("metrics.rmse"))
        return listed.join(best_models(listed).select("model_name", "horizon_hours"), ["model_name", "horizon_hours"])

    def load_best(self, horizon: int) -> tuple[PipelineModel, list[str]]:
        """The best model of a horizon and its feature names."""
        row = self.best().where(F.col("horizon_hours") == horizon).first()
        if row is None:
            raise LookupError(f"no model for {horizon} hours")
        return self.load(row.model_name, horizon), list(row.feature_names)
