"""Reader for the turbofan run-to-failure text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.assemble import minmax_scale
from wearline.operators.labels import assign_rul

# Dataset ids, the 26 file columns in order, and the sensors that hardly vary.
DATASETS = ["FD001", "FD002", "FD003", "FD004"]
SETTINGS = ["op_setting_1", "op_setting_2", "op_setting_3"]
SENSORS = [
    "fan_inlet_temp",
    "lpc_outlet_temp",
    "hpc_outlet_temp",
    "lpt_outlet_temp",
    "total_pressure_r2",
    "total_pressure_r3",
    "burner_pressure",
    "lpt_pressure",
    "bleed_enthalpy",
    "engine_speed_physical",
    "engine_speed_corrected",
    "fan_speed_ratio",
    "corrected_fan_speed",
    "duct_pressure_ratio",
    "hpc_efficiency",
    "hpc_flow_balance",
    "bypass_ratio",
    "burner_fuel_ratio",
    "lpt_efficiency",
    "bleed_flow",
    "hpb_bleed_coolant",
]
COLUMNS = ["engine_id", "cycle", *SETTINGS, *SENSORS]
LOW_VARIANCE = ["engine_speed_physical", "hpc_flow_balance", "duct_pressure_ratio", "hpb_bleed_coolant"]
EPOCH = "2020-01-01 00:00:00"


def scan_text(spark: SparkSession, folder: str, datasets: list[str] = DATASETS) -> DataFrame:
    """Typed rows of ``train_<id>.txt``; a row without 26 fields fails the read."""
    unknown = sorted(set(datasets) - set(DATASETS))
    if unknown:
        raise ValueError(f"unknown datasets {unknown}, expected some of {DATASETS}")
    lines = spark.read.text([f"{folder}/train_{d}.txt" for d in datasets])
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"train_(FD\d+)\.txt", 1).alias("dataset_id"),
        fields.alias("f"),
        F.trim("value").alias("text"),
    ).where(F.col("text") != "")
    checked = F.when(F.size("f") == len(COLUMNS), F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("expected 26 columns, got "), F.size("f").cast("string")))
    )
    kinds = {"engine_id": "int", "cycle": "int"}
    return rows.select("dataset_id", checked.alias("f")).select(
        "dataset_id",
        *[F.col("f")[i].cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(COLUMNS)],
    )


def load(spark: SparkSession, folder: str, datasets: list[str] = DATASETS) -> DataFrame:
    """Rows with uncapped ``rul`` and sensors scaled per dataset; settings untouched."""
    raw = scan_text(spark, folder, datasets)
    labelled = assign_rul(raw, cap=None, keys=["dataset_id", "engine_id"])
    return minmax_scale(labelled.withColumnRenamed("rul_cycles", "rul"), SENSORS, ["dataset_id"])


def readings(df: DataFrame) -> DataFrame:
    """Reading rows: machine id, synthetic time, and two maps rounded to six places."""

    def as_map(names: list[str]):
        return F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.round(n, 6) for n in names])
        )

    start = F.unix_seconds(F.to_timestamp(F.lit(EPOCH)))
    return df.select(
        F.format_string("CMAPSS-%s-%04d", "dataset_id", "engine_id").alias("machine_id"),
        F.timestamp_seconds(start + F.col("cycle")).alias("recorded_at"),
        "cycle",
        as_map(SENSORS).alias("readings"),
        as_map(SETTINGS).alias("operational"),
    )
