"""Model catalog as an append-only event log, and promotion decisions.

Each event puts one version of a model type into a stage. The latest event of
a version is its stage, so promotion and rollback append two rows and never
update one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.schemas import CATALOG_EVENT
from wearline.sources.tables import append, latest_by_key


def current_versions(log: DataFrame) -> DataFrame:
    return latest_by_key(log, ["model_type", "version"], ["event_no"])


def in_stage(log: DataFrame, stage: str) -> DataFrame:
    """Newest version per model type in the stage."""
    return latest_by_key(
        current_versions(log).where(F.col("stage") == stage), ["model_type"], ["version"]
    )


def run_of_version(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions with the attributes of the training run they came from."""
    return current_versions(log).join(runs, "run_id", "inner")


class ModelLog:
    """The log under one path, plus where model files lie."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._loaded: dict[tuple[str, int], PipelineModel] = {}

    def read(self) -> DataFrame:
        return self.spark.read.schema(CATALOG_EVENT).parquet(self.path)

    def _write(self, rows: list[tuple], after: int) -> None:
        numbered = [(*row, after + i + 1) for i, row in enumerate(rows)]
        append(self.spark.createDataFrame(numbered, CATALOG_EVENT), self.path)

    def _last(self, model_type: str) -> tuple[int, int]:
        """Highest event number overall and highest version of the type."""
        try:
            log = self.read()
            same = F.when(F.col("model_type") == model_type, F.col("version"))
            row = log.agg(F.max("event_no").alias("e"), F.max(same).alias("v")).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # nothing registered yet
                return 0, 0
            raise
        return row["e"] or 0, row["v"] or 0

    def register(self, model_type: str, run_id: str, artifact: str, at, mae=None, f1=None) -> int:
        """A new version in staging; returns its number."""
        event, version = self._last(model_type)
        row = (model_type, run_id, version + 1, "staging", mae, f1, artifact, at)
        self._write([row], event)
        return version + 1

    def _row(self, model_type: str, stage: str):
        return in_stage(self.read(), stage).where(F.col("model_type") == model_type).first()

    def production(self, model_type: str):
        """Row of the version in production, or None."""
        return self._row(model_type, "production") if self._last(model_type)[0] else None

    def _moved(self, row, stage: str, at) -> tuple:
        return (
            row["model_type"], row["run_id"], row["version"], stage,
            row["mae"], row["f1"], row["artifact_path"], at,
        )

    def promote(self, model_type: str, version: int, at) -> None:
        event, _ = self._last(model_type)
        new = (
            current_versions(self.read())
            .where((F.col("model_type") == model_type) & (F.col("version") == version))
            .first()
        )
        if new is None:
            raise ValueError(f"no version {version} of {model_type}")
        old = self.production(model_type)
        rows = [] if old is None else [self._moved(old, "archived", at)]
        self._write([*rows, self._moved(new, "production", at)], event)

    def rollback(self, model_type: str, at) -> int:
        """Newest archived version back to production, the current one archived."""
        event, _ = self._last(model_type)
        back, now = self._row(model_type, "archived"), self.production(model_type)
        if back is None:
            raise ValueError(f"no archived version of {model_type}")
        rows = [] if now is None else [self._moved(now, "archived", at)]
        self._write([*rows, self._moved(back, "production", at)], event)
        return back["version"]

    def load_production(self, model_type: str) -> tuple[int, PipelineModel]:
        """Production model, re-read only when its version changed; call once per micro-batch."""
        row = self.production(model_type)
        if row is None:
            raise ValueError(f"no production version of {model_type}")
        key = (model_type, row["version"])
        if key not in self._loaded:
            self._loaded = {k: v for k, v in self._loaded.items() if k[0] != model_type}
            self._loaded[key] = PipelineModel.load(row["artifact_path"])
        return row["version"], self._loaded[key]


def promotion(has_production: bool, auto_promote: bool, comparison: DataFrame | None) -> bool:
    """Promote when nothing is in production, when told to, or when the challenger won."""
    if not has_production or auto_promote:
        return True
    return bool(comparison is not None and comparison.first()["challenger_better"])


def should_retrain(forced: Column, data_drift: Column, concept_drift: Column) -> Column:
    """A forced run, or drift of either kind; unknown counts as no drift."""
    return forced | F.coalesce(data_drift, F.lit(False)) | F.coalesce(concept_drift, F.lit(False))
