"""Shared pieces: stored intermediate tables, worker state, copies of rows, text of a document."""

from __future__ import annotations

import ctypes
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import session

SPACES = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 8 << 20


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    The files go when the session's JVM ends. A lost executor costs nothing,
    since readers find the table in shared storage.
    """
    spark = df.sparkSession
    path = f"{session.shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(name: str, make: Callable):
    """``make()`` once per Python worker process; functions travel by value, so module globals do not last."""
    state = sys.modules.setdefault("_wearline_worker", types.ModuleType("_wearline_worker"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


class Carried:
    """A broadcast object of a class of this package, for executors that do not have the package.

    A plain broadcast names the class; this one carries it, and each worker
    keeps the last object of a kind it has read.
    """

    def __init__(self, spark: SparkSession, value: object):
        self.raw, self.kind, self.key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), type(value).__name__, uuid.uuid4().hex

    @property
    def value(self):
        held = per_worker("carried", dict)
        if held.get(self.kind, (None,))[0] != self.key:
            held[self.kind] = (self.key, pickle.loads(self.raw.value))
        return held[self.kind][1]


def text_of(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text counts as empty."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Give freed memory back to the system: a worker lives on and serves other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if batch.nbytes <= size:
            if n:
                yield batch
            release()
            continue
        lengths = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + lengths[end] <= size):
                total += int(lengths[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
        release()
