"""Training and scoring with pyspark.ml."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import scoring
from wearline.operators.assemble import impute
from wearline.operators.labels import serving_health_of, with_class_weight
from wearline.operators.metrics import classification_metrics, regression_metrics
from wearline.operators.splits import walk_forward_folds
from wearline.plans import forests
from wearline.schemas import HEALTH_LABELS

# Default model sizes.
FOREST_TREES, FOREST_DEPTH = 200, 20
BOOST_TREES, BOOST_DEPTH = 100, 4
ENSEMBLE_TREES = 20
SEED = 42
MIN_TRAINING_ROWS = 500
FOLDS_AT_ONCE = 5
_VECTOR = "_features"


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=_VECTOR, handleInvalid="keep")


def _with_label_index(df: DataFrame, label: str) -> DataFrame:
    """Index in the fixed label order; the metadata keeps all classes even if one is absent."""
    order = F.array(*[F.lit(name) for name in HEALTH_LABELS])
    nominal = {"ml_attr": {"type": "nominal", "vals": HEALTH_LABELS, "name": "_label"}}
    index = (F.array_position(order, F.col(label)) - 1).cast("double")
    return df.withColumn("_label", index.alias("_label", metadata=nominal))


def train_health(
    df: DataFrame,
    features: list[str],
    label: str = "health_label",
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    seed: int = SEED,
) -> PipelineModel:
    """Random forest on balanced class weights, a tree a task; Spark's own learner fits rows beyond a task's memory."""
    stage = assembler(features)
    rows = _with_label_index(with_class_weight(impute(df, features), label), label)
    grown = forests.fit_classifier(rows, features, "_label", "weight", len(HEALTH_LABELS), trees, depth, seed)
    if grown is not None:
        return PipelineModel([stage, grown])
    forest = RandomForestClassifier(
        featuresCol=_VECTOR,
        labelCol="_label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        cacheNodeIds=True,  # same trees; else every pass sends them to the tasks and walks each row down from the root
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_class",
    )
    ready = stage.transform(rows).select(_VECTOR, "_label", "weight")
    return PipelineModel([stage, forest.fit(ready)])


def predict_health(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``predicted_label`` and ``health_probabilities`` in the fixed label order."""
    shares = vector_to_array("_probability")
    return (
        model.transform(impute(df, features))
        .withColumn("predicted_label", scoring.top_label(shares))
        .withColumn("health_probabilities", scoring.named_probabilities(shares))
        .drop(_VECTOR, "_raw", "_probability", "_class")
    )


def feature_importance(model: PipelineModel, df: DataFrame, features: list[str], n: int = 20) -> DataFrame:
    """Top-n features of the fitted forest, most important first."""
    forest: forests.ForestModel | RandomForestClassificationModel = model.stages[-1]
    pairs = [(name, float(forest.featureImportances[i])) for i, name in enumerate(features)]
    rows = df.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(n)


def train_rul(
    df: DataFrame,
    features: list[str],
    label: str = "rul_cycles",
    trees: int = BOOST_TREES,
    depth: int = BOOST_DEPTH,
    seed: int = SEED,
) -> PipelineModel:
    """Gradient-boosted regressor, boosted in one task if that holds the rows; features may be flattened sequences."""
    stage = assembler(features)
    rows = impute(df, features).withColumn(label, F.col(label).cast("double"))
    boost = GBTRegressor(
        featuresCol=_VECTOR, labelCol=label, maxIter=trees, maxDepth=depth, seed=seed,
        predictionCol="predicted_rul", checkpointInterval=10,
    )
    boosted = forests.fit_boosted(rows, boost, features)
    return PipelineModel([stage, boosted or boost.fit(stage.transform(rows).select(_VECTOR, label))])


def train_rul_ensemble(
    df: DataFrame,
    features: list[str],
    label: str = "rul_cycles",
    trees: int = ENSEMBLE_TREES,
    depth: int = 8,
    seed: int = SEED,
) -> PipelineModel:
    """Forest regressor whose trees are the sample behind the interval."""
    stage = assembler(features)
    rows = impute(df, features).withColumn(label, F.col(label).cast("double"))
    forest = RandomForestRegressor(
        featuresCol=_VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
        predictionCol="predicted_rul", cacheNodeIds=True,
    )
    return PipelineModel([stage, forest.fit(stage.transform(rows).select(_VECTOR, label))])


def predict_rul(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(impute(df, features)).drop(_VECTOR)


def predict_rul_interval(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds rul_cycles, bounds, hours, confidence, anomaly score and the serving label."""
    forest: RandomForestRegressionModel = model.stages[-1]
    out = model.stages[0].transform(impute(df, features))
    names = [f"_tree{i}" for i in range(len(forest.trees))]
    for tree, name in zip(forest.trees, names):
        out = tree.setPredictionCol(name).transform(out)
    out = out.withColumn("_i", scoring.interval(F.array(*names)))
    out = out.drop(*names, _VECTOR, *[c for c in ("rul_cycles",) if c in out.columns])
    out = out.select("*", "_i.*").drop("_i")
    sure = scoring.confidence(
        F.col("rul_cycles"), F.col("rul_lower_bound"), F.col("rul_upper_bound")
    )
    return (
        out.withColumn("rul_hours", scoring.rul_hours(F.col("rul_cycles")))
        .withColumn("confidence", sure)
        .withColumn("anomaly_score", scoring.anomaly_score(F.col("confidence")))
        .withColumn("serving_label", serving_health_of(F.col("rul_cycles")))
    )


def score_features(
    df: DataFrame,
    rul_model: PipelineModel,
    health_model: PipelineModel,
    features: list[str],
    versions: tuple[str, str],
    time: str = "computed_at",
) -> DataFrame:
    """Feature rows to prediction rows; works on streams. Unusable rows are skipped."""
    usable = df.where(scoring.valid_id(F.col("machine_id")) & F.col(time).isNotNull())
    scored = predict_health(health_model, predict_rul_interval(rul_model, usable, features), features)
    return scored.select(
        "machine_id",
        F.col(time).alias("predicted_at"),
        "rul_cycles",
        "rul_hours",
        "rul_lower_bound",
        "rul_upper_bound",
        F.col("predicted_label").alias("health_label"),
        "health_probabilities",
        "anomaly_score",
        "confidence",
        F.lit(versions[0]).alias("rul_model_version"),
        F.lit(versions[1]).alias("health_model_version"),
        F.lit(0).alias("latency_ms"),
    )


def score_batch(
    requests: DataFrame,
    rul_model: PipelineModel,
    health_model: PipelineModel,
    features: list[str],
) -> DataFrame:
    """Mixed scoring requests, one answer row each, in the given ``ordinal``.

    Requests have ``ordinal``, ``machine_id``, ``prediction_type`` (rul or
    health), ``feature_sequence`` (array of maps) and ``features`` (map). A bad
    request gets ``success`` false and its ``error``; the others are scored. The
    last step of a sequence feeds the regressor.
    """
    kind = F.col("prediction_type")
    checked = requests.withColumn(
        "error", scoring.scoring_error(kind, F.col("feature_sequence"), F.col("features"))
    )
    used = F.when(kind == "rul", F.element_at("feature_sequence", -1)).otherwise(F.col("features"))
    good = checked.where(F.col("error").isNull()).select(
        "ordinal",
        "machine_id",
        "prediction_type",
        *[F.try_element_at(used, F.lit(n)).cast("double").alias(n) for n in features],
    )
    rul = predict_rul_interval(rul_model, good.where(kind == "rul"), features).select(
        "ordinal",
        "machine_id",
        "prediction_type",
        "rul_cycles",
        "rul_hours",
        "rul_lower_bound",
        "rul_upper_bound",
        "confidence",
        F.col("serving_label").alias("health_label"),
    )
    health = predict_health(health_model, good.where(kind == "health"), features).select(
        "ordinal",
        "machine_id",
        "prediction_type",
        F.col("predicted_label").alias("health_label"),
        "health_probabilities",
    )
    answers = rul.unionByName(health, allowMissingColumns=True)
    failed = checked.where(F.col("error").isNotNull()).select(
        "ordinal", "machine_id", "prediction_type", "error"
    )
    return (
        answers.withColumn("success", F.lit(True))
        .unionByName(failed.withColumn("success", F.lit(False)), allowMissingColumns=True)
        .orderBy("ordinal")
    )


def cross_validate(
    df: DataFrame,
    features: list[str],
    order: list[str],
    label: str,
    *,
    n_folds: int = 5,
    gap: int = 0,
    classify: bool = False,
    **size: int,
) -> DataFrame:
    """Metrics per walk-forward fold; each fold fits on its train rows only.

    Folds are fitted side by side: a boosting round is a few short jobs, which
    alone leave most of a cluster waiting.
    """
    folds = walk_forward_folds(df, order, n_folds, gap)

    def scores(fold: int) -> DataFrame:
        rows = folds.where(F.col("fold_id") == fold)
        train, test = rows.where(F.col("role") == "train"), rows.where(F.col("role") == "test")
        if classify:
            model = train_health(train, features, label, **size)
            scored = predict_health(model, test, features)
            m = classification_metrics(scored, label, "predicted_label").select("accuracy", "macro_f1")
        else:
            model = train_rul(train, features, label, **size)
            scored = predict_rul(model, test, features)
            m = regression_metrics(scored, label, "predicted_rul").select("mae", "rmse", "r2")
        return m.withColumn("fold_id", F.lit(fold))

    with ThreadPool(min(n_folds, FOLDS_AT_ONCE)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(scores), range(n_folds), chunksize=1)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usable_model(scored: DataFrame, column: str) -> bool:
    """Shadow check on real rows: a model must answer every one of them with a number."""
    value = F.col(column)
    bad = value.isNull()
    if dict(scored.dtypes)[column] == "double":
        bad = bad | F.isnan(value)
    row = scored.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    return row["n"] > 0 and row["bad"] == 0
