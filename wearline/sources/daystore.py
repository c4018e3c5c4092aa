"""Tables of one folder per day under a manifest, fed by micro-batch folders, and roll-ups that follow them.

A version of a table is one small file that names the folder of every day. It is
put in place by a rename that fails if that version exists, so readers see whole
versions and of two writers one wins. Days are rewritten, never changed in
place; a roll-up notes which folder of its source each day was made from, so the
days to make again are those whose folder differs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.sources.tables import DAY, day_of

EMPTY = {"version": 0, "through": -1, "schema": None, "days": {}, "sources": {}}


class Conflict(RuntimeError):
    """Another writer has put this version in place."""


class DayStore:
    """A table under ``root``: ``manifest/`` holds its versions, ``data/`` the folders they name.

    The manifest has one entry per stored day; it is read and written by the
    driver. Works on file systems whose rename is atomic.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's content, the latest by default; an empty table has version 0."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {**EMPTY, "days": {}, "sources": {}}
        stream = self.fs.open(self._path(f"manifest/v{version}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Puts the manifest in place as the version after the one it was made from."""
        manifest = {**manifest, "version": manifest["version"] + 1}
        draft = self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.files.rename(draft, self._path(f"manifest/v{manifest['version']}.json"), plain)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass()):
                raise Conflict(f"version {manifest['version']} of {self.root}") from None
            raise
        return manifest

    def read(self, days: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the given days (all by default): one folder per day is opened."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        schema = T.StructType.fromJson(found["schema"])
        wanted = [f for d, f in sorted(found["days"].items()) if days is None or d in days]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in wanted])

    def between(self, first: date, last: date) -> DataFrame:
        return self.read([d for d in self.manifest()["days"] if first.isoformat() <= d <= last.isoformat()])

    def rewritten(self, manifest: dict, rows: DataFrame, time: str, days: list[str]) -> dict:
        """``manifest`` with the given days replaced by ``rows``; days without rows leave the table."""
        run = f"run-{uuid.uuid4().hex}"
        dated = rows.withColumn(DAY, day_of(F.col(time)))
        # a day's rows come from one writer or, beyond the advised size, from several
        dated.hint("rebalance", F.col(DAY)).write.partitionBy(DAY).parquet(f"{self.root}/data/{run}")
        written = {n.removeprefix(f"{DAY}="): f"{run}/{n}" for n in self._names(f"data/{run}") if n.startswith(DAY)}
        kept = {d: f for d, f in manifest["days"].items() if d not in days}
        return {**manifest, "schema": json.loads(rows.schema.json()), "days": {**kept, **written}}

    def absorb(self, batches: str, time: str, batch: str = "batch_id") -> list[str]:
        """Merges the micro-batch folders that came since the last version into their days; returns those days.

        Batches are numbered upwards. A batch written again after it was absorbed
        is not read again. Rows without a time stay in a day of their own.
        """
        manifest = self.manifest()
        new = self.spark.read.parquet(batches).where(F.col(batch) > manifest["through"])
        top, days = new.agg(F.max(batch)).first()[0], []
        if top is None:
            return days
        new = new.drop(batch)
        found = new.select(day_of(F.col(time)).alias("d")).distinct().collect()
        days = sorted("__HIVE_DEFAULT_PARTITION__" if r["d"] is None else r["d"].isoformat() for r in found)
        held = [d for d in days if d in manifest["days"]]
        rows = self.read(held).unionByName(new) if held else new
        self.commit({**self.rewritten(manifest, rows, time, days), "through": top})
        return days

    def follow(self, source: DayStore, make: Callable[[DataFrame], DataFrame], time: str) -> list[str]:
        """Makes the days again whose folder in ``source`` is not the one they were made from; returns them.

        ``make`` must give each of its rows from one day of the source alone.
        """
        manifest, base = self.manifest(), source.manifest()
        changed = sorted(d for d in {*base["days"], *manifest["sources"]} if base["days"].get(d) != manifest["sources"].get(d))
        if not changed:
            return []
        made = make(source.read(changed, base["version"]))
        self.commit({**self.rewritten(manifest, made, time, changed), "sources": base["days"]})
        return changed

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the data that none of the latest ``keep`` versions names, and older versions; returns folders deleted."""
        versions = self.versions()
        named = {f.split("/")[0] for v in versions[-keep:] for f in self.manifest(v)["days"].values()}
        stale = [n for n in self._names("data") if n not in named]
        for name in stale:
            self.fs.delete(self._path(f"data/{name}"), True)
        for version in versions[:-keep]:
            self.fs.delete(self._path(f"manifest/v{version}.json"), False)
        return len(stale)
