"""Tree models whose trees are grown a task each, over binned rows that every task can hold.

A pass of Spark's own learners sends a histogram of every open node from every
partition through a shuffle; a forest of depth 20 has millions of open nodes with a
few rows each, and boosting is hundreds of short passes. Binned, a row is a byte
per feature, and equal rows come once with their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions import trees

BINS = 32
#: Bytes of distinct binned rows that one task takes; beyond them Spark's learners fit.
TASK_BYTES = 256 << 20


def borders_of(df: DataFrame, features: list[str], weight: str | None = None) -> list[list[float]]:
    """Borders of each feature's bins, from all rows: distinct values are counted first, then cut by feature."""
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)])
    each = df.select(F.inline(entries), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    counted = each.groupBy("place", "x").agg(F.sum("w").alias("w"), F.count("*").alias("n"))

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows["x"].to_numpy()
        if not np.isfinite(x).all():
            raise ValueError("a feature is null, NaN or infinite")
        order = np.argsort(x)
        found = trees.thresholds(x[order], rows["w"].to_numpy()[order], min(BINS, int(rows["n"].to_numpy().sum())))
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "found": pa.array([found], pa.list_(pa.float64()))})

    got = {r["place"]: r["found"] for r in counted.groupBy("place").applyInArrow(cut, "place int, found array<double>").collect()}
    if not got:
        raise ValueError("no rows to train on")
    return [got[i] for i in range(len(features))]


def binned_rows(df: DataFrame, features: list[str], borders: list[list[float]], label: str) -> DataFrame:
    """Binned rows: ``key`` with a byte per feature, ``label``, and the partition they were in."""

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]]
            keys = np.ascontiguousarray(trees.binned(columns, borders).T)
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(borders)), len(keys), [None, pa.py_buffer(keys)])
            yield pa.record_batch([held.cast(pa.binary()), *batch.columns[-2:]], names=["key", "label", "part"])

    columns = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    rows = df.select(*columns, F.col(label).cast("double").alias("label"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "key binary, label double, part int")


def _held(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and labels of collected rows."""
    label = table["label"].to_numpy()  # null as NaN
    if np.isnan(label).any():
        raise ValueError("a label is null or NaN")
    keys = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(keys.T), label


def distinct_rows(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and counts in an order that depends on the rows only, not on how they lay."""
    bins, label = _held(rows, width)
    order = np.lexsort([label, *bins])
    return np.ascontiguousarray(bins[:, order]), label[order], rows["n"].to_numpy()[order]


def fit_classifier(
    df: DataFrame, features: list[str], label: str, weight: str, classes: int, n_trees: int, depth: int, seed: int
) -> ForestModel | None:
    """A random forest as Spark's classifier grows it; None when the rows are too many for a task.

    ``label`` is a class number, ``weight`` is the same for all rows of a class. Each
    tree draws from its own stream of random numbers, seeded by its number, so a
    forest depends neither on partitions nor on the order of the rows.
    """
    spark = df.sparkSession
    weights = {r["c"]: r["w"] for r in df.groupBy(F.col(label).alias("c")).agg(F.first(weight).alias("w")).collect()}
    borders = borders_of(df, features, weight)
    rows = binned_rows(df, features, borders, label).groupBy("key", "label").agg(F.count("*").alias("n"))
    if rows.count() * len(features) > TASK_BYTES:
        return None
    bins, labels, count = distinct_rows(rows.toArrow(), len(features))
    if not np.isin(labels, np.arange(classes)).all():
        raise ValueError(f"a label is none of the {classes} classes")
    subset = len(features) if n_trees == 1 else int(np.ceil(np.sqrt(len(features))))
    weighted = np.array([weights.get(float(c), 0.0) for c in range(classes)])
    shared = spark.sparkContext.broadcast((bins, labels.astype(np.uint8), count, weighted))

    def grow(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                tree, importance = trees.classifier(*shared.value, BINS, depth, subset, [seed, i])
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([trees.packed(tree)], pa.binary()), pa.array([importance], pa.list_(pa.float64()))], names=["id", "body", "importance"])

    tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
    grown = spark.range(0, n_trees, 1, tasks).mapInArrow(grow, "id long, body binary, importance array<double>").toArrow().sort_by("id")
    shared.destroy()
    total = np.sum(grown["importance"].to_pylist(), axis=0)
    return ForestModel(features, borders, grown["body"].to_pylist(), (total / total.sum() if total.sum() > 0 else total).tolist())


class ForestModel(Model, MLWritable, MLReadable):
    """A fitted forest: packed trees that one broadcast brings to the tasks, ``_probability`` as a vector."""

    cacheNodeIds = Param(
        Params._dummy(), "cacheNodeIds", "whether rows remember their node between levels", TypeConverters.toBoolean
    )

    def __init__(self, features: list[str] = [], borders: list = [], bodies: list[bytes] = [], importances: list[float] = []):
        super().__init__()
        self._set(cacheNodeIds=True)
        self.features, self.borders, self.bodies, self.importances = features, borders, bodies, importances
        self._shared = None

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.importances)

    @property
    def getNumTrees(self) -> int:
        return len(self.bodies)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast((self.borders, self.bodies))
        shared, classes = self._shared, trees.unpacked(self.bodies[0])["values"].shape[1]
        names = [f"p{i}" for i in range(classes)]

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            borders, bodies = shared.value
            forest = [trees.unpacked(body) for body in bodies]
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # one feature comes bare
                votes = trees.shares(forest, trees.binned([c.to_numpy(np.float64) for c in columns], borders))
                total = votes.sum(1, keepdims=True)
                yield pd.DataFrame(np.divide(votes, total, out=votes, where=total > 0), columns=names)

        probability = F.pandas_udf(score, ", ".join(f"{n} double" for n in names))
        found = dataset.withColumn("_shares", probability(*[F.col(c).cast("double") for c in self.features]))
        listed = F.array(*[F.col(f"_shares.{n}") for n in names])
        return found.withColumn("_probability", array_to_vector(listed)).drop("_shares")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        m = self.instance
        extra = {"features": m.features, "borders": m.borders, "importances": m.importances}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        table = pa.table({"id": pa.array(range(len(m.bodies)), pa.int64()), "body": pa.array(m.bodies, pa.binary())})
        self.sparkSession.createDataFrame(table).write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ForestModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").toArrow().sort_by("id")
        out = ForestModel(known["features"], known["borders"], rows["body"].to_pylist(), known["importances"])
        out._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(out, known)
        return out


def fit_boosted(df: DataFrame, boost: GBTRegressor, features: list[str]) -> GBTRegressionModel | None:
    """Spark's own model, boosted in one task instead of a few passes per level and round; None when the rows are too many for it.

    No random number takes part: borders come from all rows, every tree sees every row in the order of its partition.
    """
    spark = df.sparkSession
    borders = borders_of(df, features)
    if df.count() * (len(features) + 12) > TASK_BYTES:
        return None
    rows = binned_rows(df, features, borders, boost.getLabelCol()).toArrow()
    shared = spark.sparkContext.broadcast((*_held(rows, len(features)), rows["part"].to_numpy().astype(np.int64)))
    sizes = BINS, boost.getMaxDepth(), boost.getMaxIter(), boost.getStepSize()

    def grow(batches):
        for _ in batches:
            for i, tree in enumerate(trees.boosted(*shared.value, *sizes)):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([trees.packed(tree)], pa.binary())], names=["id", "body"])

    grown = spark.range(0, 1, 1, 1).mapInArrow(grow, "id int, body binary").toArrow().sort_by("id")
    shared.destroy()
    found = [trees.unpacked(body) for body in grown["body"].to_pylist()]
    weights = [1.0] + [boost.getStepSize()] * (len(found) - 1)
    return boost._copyValues(GBTRegressionModel(_java_ensemble(spark, boost.uid, found, weights, borders)))


def _java_ensemble(spark: SparkSession, uid: str, found: list[dict], weights: list[float], borders: list[list[float]]):
    """Trees of ``trees.regressor`` as Spark's model of gradient-boosted trees."""
    ml, gateway = spark._jvm.org.apache.spark.ml, spark.sparkContext._gateway
    mllib, slots = spark._jvm.org.apache.spark.mllib, spark._jvm.java.util.Arrays
    whole = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(found))
    for i, tree in enumerate(found):
        stats, child, nodes = tree["stats"], tree["child"].tolist(), {}
        mean, spread = (stats[:, 1] / stats[:, 0]).tolist(), trees._variance(stats).tolist()
        held = mllib.linalg.Vectors.parse(str(stats.ravel().tolist())).toArray()
        for at in reversed(range(len(child))):  # children come after their parents
            calculator = mllib.tree.impurity.VarianceCalculator(slots.copyOfRange(held, 3 * at, 3 * at + 3), int(stats[at, 0]))
            f = int(tree["feature"][at])
            if f == trees.LEAF:
                nodes[at] = ml.tree.LeafNode(mean[at], spread[at], calculator)
            else:
                split = ml.tree.ContinuousSplit(f, float(borders[f][int(tree["bin"][at])]))
                nodes[at] = ml.tree.InternalNode(mean[at], spread[at], float(tree["gain"][at]), nodes.pop(child[at]), nodes.pop(child[at] + 1), split, calculator)
        whole[i] = ml.regression.DecisionTreeRegressionModel(f"{uid}_tree{i}", nodes[0], len(borders))
    of_trees = gateway.new_array(gateway.jvm.double, len(weights))
    for i, w in enumerate(weights):
        of_trees[i] = w
    return ml.regression.GBTRegressionModel(f"{uid}_model", whole, of_trees, len(borders))
