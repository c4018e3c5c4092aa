from datetime import timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tests.conftest import BASE
from wearline.functions import trees
from wearline.plans import forests, queries_models, training
from wearline.schemas import HEALTH_LABELS

FEATURES = ["a", "b", "c"]
WEIGHT = [0.5, 2.0, 1.0, 3.0]


@pytest.fixture(scope="module")
def rows(spark):
    """Two features with many values and zeros, one with few; every tenth row comes twice."""
    draw = np.random.default_rng(5)
    made = []
    for i in range(900):
        a, b, c = draw.normal(), float(draw.integers(-20, 60)) * (i % 3 > 0), float(draw.integers(0, 4))
        kind = int(np.clip(a + b / 30 + c / 4 + draw.normal() * 0.5, 0, 3.9))
        made += [(i, a, b, c, float(kind), WEIGHT[kind], HEALTH_LABELS[kind], a * 40 + b)] * (1 + (i % 10 == 0))
    schema = "id int, a double, b double, c double, label double, w double, health_label string, rul_cycles double"
    return spark.createDataFrame(made, schema).repartition(5).cache()


class Whole:
    """Every row drawn as often as it is there, features in order."""

    def poisson(self, count):
        return count

    def random(self, shape):
        return np.zeros(shape)


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_a_tree_equals_sparks(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(trees, "CELLS", cells)
    stage = training.assembler(FEATURES)
    ready = stage.transform(rows)
    spark_tree = DecisionTreeClassifier(featuresCol="_features", labelCol="label", weightCol="w", maxDepth=7).fit(ready)
    borders = forests.borders_of(rows, FEATURES, "w")
    counted = forests.binned_rows(rows, FEATURES, borders, "label").groupBy("key", "label").agg(F.count("*").alias("n"))
    bins, label, count = forests.distinct_rows(counted.toArrow(), 3)
    assert count.sum() == rows.count() > len(count)
    monkeypatch.setattr(np.random, "default_rng", lambda seed: Whole())
    tree, importance = trees.classifier(bins, label.astype(np.uint8), count, np.array(WEIGHT), forests.BINS, 7, 3, 0)
    assert len(tree["feature"]) == spark_tree.numNodes > 50
    assert importance == pytest.approx(spark_tree.featureImportances.toArray())
    scored = spark_tree.transform(ready).select(*FEATURES, vector_to_array("probability").alias("p")).toPandas()
    got = trees.shares([trees.unpacked(trees.packed(tree))], trees.binned([scored[c].to_numpy() for c in FEATURES], borders))
    assert got == pytest.approx(np.array(scored["p"].tolist()))


def test_a_forest_is_grown_without_sparks_passes(rows, monkeypatch):
    """Alike in quality, the same whatever the partitions, and whole after a save."""
    stage = training.assembler(FEATURES)
    by_spark = training.predict_health(
        PipelineModel([stage, RandomForestClassifier(
            featuresCol="_features", labelCol="label", weightCol="w", numTrees=30, maxDepth=8, seed=1,
            probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class",
        ).fit(stage.transform(rows))]), rows, FEATURES)
    agrees = F.avg((F.col("health_label") == F.col("predicted_label")).cast("double"))
    was = by_spark.agg(agrees).first()[0]

    def never(*args):
        raise AssertionError("passes over all rows")

    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    model = training.train_health(rows, FEATURES, trees=30, depth=8)
    again = training.train_health(rows.repartition(2, "b"), FEATURES, trees=30, depth=8)
    assert model.stages[-1].getNumTrees == 30 and model.stages[-1].bodies == again.stages[-1].bodies
    assert len(set(model.stages[-1].bodies)) == 30
    assert model.stages[-1].featureImportances.toArray().sum() == pytest.approx(1.0)
    now = training.predict_health(model, rows, FEATURES).agg(agrees).first()[0]
    assert abs(now - was) < 0.05 and now > 0.8


def test_a_saved_forest_scores_alike(rows, tmp_path):
    model = training.train_health(rows, FEATURES, trees=4, depth=5)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.stages[-1].uid == model.stages[-1].uid and loaded.stages[-1].getOrDefault("cacheNodeIds")
    assert loaded.stages[-1].featureImportances == model.stages[-1].featureImportances
    one, two = (
        {r["id"]: r["health_probabilities"] for r in training.predict_health(m, rows, FEATURES).collect()} for m in (model, loaded)
    )
    assert one == two and len(one) == 900


def test_rows_beyond_a_task_go_to_sparks_learner(rows, monkeypatch):
    monkeypatch.setattr(forests, "TASK_BYTES", 100)
    model = training.train_health(rows, FEATURES, trees=3, depth=3)
    assert not isinstance(model.stages[-1], forests.ForestModel) and model.stages[-1].getNumTrees == 3


def test_unusable_rows_are_refused_and_constant_features_ignored(rows):
    with pytest.raises(Exception, match="null, NaN or infinite"):
        training.train_health(rows.withColumn("a", F.lit(float("inf"))), FEATURES, trees=2, depth=2)
    with pytest.raises(Exception, match="none of the 4 classes"):
        training.train_health(rows.withColumn("health_label", F.lit("unheard of")), FEATURES, trees=2, depth=2)
    with pytest.raises(Exception, match="no rows"):
        forests.borders_of(rows.where("false"), FEATURES)
    model = training.train_health(rows.withColumn("a", F.lit(1.0)), FEATURES, trees=3, depth=4)
    assert model.stages[-1].featureImportances[0] == 0.0
    one = training.train_health(rows.limit(1), FEATURES, trees=3, depth=4)
    assert training.predict_health(one, rows, FEATURES).count() == 990


def test_a_streams_rows_are_scored(spark, rows, tmp_path):
    model = training.train_health(rows, FEATURES, trees=3, depth=4)
    rows.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    training.predict_health(model, read, FEATURES).select("id", "predicted_label").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("predicted_label IS NOT NULL").count() == 990


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of eight users, half an hour apart: two are test machines, without their first event, whose window is too short."""
    draw, path = np.random.default_rng(3), tmp_path_factory.mktemp("tables")
    kinds = ["click", "view", "signup", "purchase", "error"]
    rows = [(i, BASE + timedelta(minutes=30 * i), i % 8, kinds[int(draw.integers(5))], float(draw.normal(50, 20)), '{"k": 7}') for i in range(480)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(r[0], r[1].replace(tzinfo=None), *r[2:]) for r in rows], schema).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name, rows", [("rf_health", 118), ("rf_health_metrics", 1), ("feature_importance", 5), ("batch_scoring", 472)])
def test_a_query_trains_200_trees_of_its_own(spark, folder, monkeypatch, name, rows):
    """One tree a task, of the library's size, without the passes of Spark's learner."""
    grown, fit = [], forests.fit_classifier

    def record(*args):
        grown.append(fit(*args))
        assert args[-3:] == (training.FOREST_TREES, training.FOREST_DEPTH, training.SEED)
        return grown[-1]

    def never(*args):
        raise AssertionError("passes over all rows")

    monkeypatch.setattr(forests, "fit_classifier", record)
    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    assert getattr(queries_models, name)(spark, folder).count() == rows
    assert [m.getNumTrees for m in grown] == [200]


def test_boosting_in_a_task_gives_sparks_trees(rows, monkeypatch, tmp_path):
    model = training.train_rul(rows, FEATURES, trees=12)
    monkeypatch.setattr(forests, "TASK_BYTES", 0)
    by_spark = training.train_rul(rows, FEATURES, trees=12).stages[-1]
    ours = model.stages[-1]
    text = [[t.toDebugString.partition("\n")[2] for t in m.trees] for m in (ours, by_spark)]
    assert text[0] == text[1] and ours.treeWeights == by_spark.treeWeights and len(text[0]) == 12
    assert ours.featureImportances.toArray() == pytest.approx(by_spark.featureImportances.toArray())
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    one, two = (sorted((r["id"], r["predicted_rul"]) for r in training.predict_rul(m, rows, FEATURES).collect()) for m in (model, loaded))
    assert one == two and len(one) == 990


def test_walk_forward_scores_need_no_pass_a_level(spark, folder, monkeypatch):
    """Five folds of 100 trees, each boosted in a task."""
    made, fit = [], forests.fit_boosted

    def never(*args):
        raise AssertionError("passes over all rows")

    def record(*args):
        made.append(fit(*args))
        return made[-1]

    monkeypatch.setattr(GBTRegressor, "fit", never)
    monkeypatch.setattr(forests, "fit_boosted", record)
    out = queries_models.walk_forward_scores(spark, folder).orderBy("fold_id").collect()
    assert [r["fold_id"] for r in out] == [0, 1, 2, 3, 4] and all(r["mae"] > 0 for r in out)
    assert [m.getNumTrees for m in made] == [100] * 5
