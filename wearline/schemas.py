"""Record layouts and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, orders and codes that results must reproduce.
HEALTH_LABELS = ["healthy", "degrading", "critical", "imminent_failure"]
SEVERITIES = ["info", "warning", "critical"]
MACHINE_TYPES = ["turbofan", "pump", "compressor", "motor"]
MACHINE_STATUSES = ["active", "maintenance", "decommissioned"]
INCIDENT_STATUSES = ["open", "acknowledged", "closed"]
SPLITS = ["train", "validation", "test"]
DRIFT_TYPES = ["data", "concept", "covariate"]
CONDITION_TYPES = [
    "rul_below",
    "anomaly_score_above",
    "health_label_is",
    "rul_drop_rate",
    "multi_sensor",
]
QUALITY_FLAGS = [
    "MISSING_ID",
    "NULL_FRACTION_HIGH",
    "NULL_FRACTION_LOW",
    "FUTURE_TIMESTAMP",
    "DUPLICATE_TIMESTAMP",
    "OUTLIER_DETECTED",
    "SENSOR_COUNT_LOW",
]
DEFAULT_WINDOWS_S = [10, 30, 60, 300]
LATENCY_BOUNDS_MS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]

_NUMBERS = T.MapType(T.StringType(), T.DoubleType())
_WORDS = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


READING = _struct(
    machine_id=T.StringType(),
    recorded_at=T.TimestampType(),
    cycle=T.IntegerType(),
    readings=_NUMBERS,
    operational=_NUMBERS,
)

FEATURES = _struct(
    machine_id=T.StringType(),
    computed_at=T.TimestampType(),
    window_s=T.IntegerType(),
    temporal=_NUMBERS,
    spectral=_NUMBERS,
    correlation=_NUMBERS,
    feature_version=T.StringType(),
)

PREDICTION = _struct(
    machine_id=T.StringType(),
    predicted_at=T.TimestampType(),
    rul_cycles=T.DoubleType(),
    rul_hours=T.DoubleType(),
    rul_lower_bound=T.DoubleType(),
    rul_upper_bound=T.DoubleType(),
    health_label=T.StringType(),
    health_probabilities=_NUMBERS,
    anomaly_score=T.DoubleType(),
    confidence=T.DoubleType(),
    rul_model_version=T.StringType(),
    health_model_version=T.StringType(),
    latency_ms=T.IntegerType(),
)

RULE = _struct(
    rule_id=T.StringType(),
    rule_name=T.StringType(),
    description=T.StringType(),
    severity=T.StringType(),
    condition_type=T.StringType(),
    thresholds=_WORDS,
    cooldown_s=T.IntegerType(),
    enabled=T.BooleanType(),
)

INCIDENT = _struct(
    incident_id=T.StringType(),
    rule_id=T.StringType(),
    machine_id=T.StringType(),
    severity=T.StringType(),
    title=T.StringType(),
    status=T.StringType(),
    details=T.StringType(),
    triggered_at=T.TimestampType(),
    created_at=T.TimestampType(),
    acknowledged_at=T.TimestampType(),
    acknowledged_by=T.StringType(),
    closed_at=T.TimestampType(),
    resolution_note=T.StringType(),
)

MACHINE = _struct(
    machine_id=T.StringType(),
    machine_type=T.StringType(),
    location=T.StringType(),
    status=T.StringType(),
    commissioned_at=T.TimestampType(),
    metadata=T.StringType(),
    updated_at=T.TimestampType(),
)

SERVICE_RECORD = _struct(
    record_id=T.LongType(),
    machine_id=T.StringType(),
    service_type=T.StringType(),
    performed_at=T.TimestampType(),
    performed_by=T.StringType(),
    notes=T.StringType(),
    rul_before=T.IntegerType(),
    rul_after=T.IntegerType(),
    metadata=T.StringType(),
)

TRAINING_JOB = _struct(
    job_id=T.LongType(),
    trigger_reason=T.StringType(),
    status=T.StringType(),
    dataset_version=T.StringType(),
    config_snapshot=T.StringType(),
    started_at=T.TimestampType(),
    completed_at=T.TimestampType(),
    error_message=T.StringType(),
)

CATALOG_EVENT = _struct(
    model_type=T.StringType(),
    run_id=T.StringType(),
    version=T.LongType(),
    stage=T.StringType(),
    mae=T.DoubleType(),
    f1=T.DoubleType(),
    artifact_path=T.StringType(),
    event_at=T.TimestampType(),
    event_no=T.LongType(),
)

DRIFT_EVENT = _struct(
    detected_at=T.TimestampType(),
    drift_type=T.StringType(),
    affected_features=T.ArrayType(T.StringType()),
    ks_statistic=T.DoubleType(),
    p_value=T.DoubleType(),
    triggered_retrain=T.BooleanType(),
    details=T.StringType(),
)

PREDICTION_AUDIT = _struct(
    machine_id=T.StringType(),
    predicted_rul=T.DoubleType(),
    actual_rul=T.DoubleType(),
    created_at=T.TimestampType(),
)

RUL_LABEL = _struct(
    machine_id=T.StringType(),
    recorded_at=T.TimestampType(),
    rul_cycles=T.DoubleType(),
)

MAINTENANCE = _struct(
    machine_id=T.StringType(),
    enabled=T.BooleanType(),
    changed_at=T.TimestampType(),
)
