"""Greedy anchored chains: cooldowns and anchored aggregation windows.

An opener holds for ``span`` seconds; the first later row outside that hold is
the next opener. Each decision depends on the previous opener, so the rows of a
key are folded in time order: Spark partitions and sorts, and an Arrow scan
carries only the last opener.

A key too large for one task is cut into time slices. A slice's effect on the
chain is a step function from "held until" to "last opener in the slice", kept
as two short arrays; one small fold per key over its slices gives every slice
its incoming opener, and the scan then runs on (key, slice) partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import session
from wearline.operators.slices import AUTO, SLICE, axis, resolve, slice_of

MICROS = 1_000_000
_KEY, _AT, _HOLD, _INCOMING = "_key", "_at", "_hold", "_incoming"


def _scan(closed: bool):
    """Arrow scan over rows sorted by (key, slice, time, tie)."""

    def fold(batches):
        current, opened = None, None
        for batch in batches:
            keys = batch.column(_KEY).to_pylist()
            cuts = batch.column(SLICE).to_pylist()
            times = batch.column(_AT).to_pylist()
            holds = batch.column(_HOLD).to_pylist()
            given = batch.column(_INCOMING).to_pylist()
            openers, flags = [], []
            for key, cut, at, hold, incoming in zip(keys, cuts, times, holds, given):
                if (key, cut) != current:
                    current, opened = (key, cut), incoming
                held = opened is not None and (
                    at - opened <= hold if closed else at - opened < hold
                )
                if not held:
                    opened = at
                openers.append(opened)
                flags.append(not held)
            arrays = batch.columns + [pa.array(openers, pa.int64()), pa.array(flags, pa.bool_())]
            names = batch.schema.names + ["_opened", "is_opener"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return fold


def _groups(batches, by: list[str], columns: list[str]):
    """(key, column lists) per run of equal ``by`` values in a sorted partition."""
    current, held = None, [[] for _ in columns]
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in by])
        rows = zip(*[batch.column(c).to_pylist() for c in columns])
        for key, row in zip(keys, rows):
            if key != current:
                if current is not None:
                    yield current, held
                current, held = key, [[] for _ in columns]
            for store, value in zip(held, row):
                store.append(value)
    if current is not None:
        yield current, held


_EFFECT = pa.schema(
    [
        (_KEY, pa.string()),
        (SLICE, pa.int64()),
        (_HOLD, pa.int64()),
        ("_upto", pa.list_(pa.int64())),
        ("_last", pa.list_(pa.int64())),
    ]
)
_CARRY = pa.schema([(_KEY, pa.string()), (SLICE, pa.int64()), (_INCOMING, pa.int64())])
_FLUSH = 10_000  # output rows per Arrow batch


def _batched(rows, schema: pa.Schema):
    """Row tuples to record batches of bounded size."""
    pending = []
    for row in rows:
        pending.append(row)
        if len(pending) >= _FLUSH:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema
            )
            pending = []
    if pending:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema
        )


def _transfer(closed: bool, length: int):
    """Effect of each slice: runs of first openers that end in the same last opener."""

    def effects(batches):
        for (key, cut), (times, holds) in _groups(batches, [_KEY, SLICE], [_AT, _HOLD]):
            at, hold, n = np.asarray(times), holds[0], len(times)
            following = np.searchsorted(at, at + hold, side="right" if closed else "left")
            last = list(range(n))
            for i in range(n - 1, -1, -1):
                if i < following[i] < n:
                    last[i] = last[following[i]]
            # Only rows up to the first one past the longest incoming hold can open the slice.
            reach = min(n, int(np.searchsorted(at, cut * length + hold, side="right")) + 1)
            ends = [i for i in range(reach) if i == reach - 1 or last[i] != last[i + 1]]
            yield key, cut, hold, [times[i] for i in ends], [times[last[i]] for i in ends]

    return lambda batches: _batched(effects(batches), _EFFECT)


def _fold_slices(closed: bool):
    """Incoming opener of every slice of one key."""

    def carries(batches):
        names = [SLICE, _HOLD, "_upto", "_last"]
        for (key,), columns in _groups(batches, [_KEY], names):
            opened = None
            for cut, hold, upto, last in zip(*columns):
                yield key, cut, opened
                if opened is None:
                    opened = last[0]
                    continue
                find = bisect_right if closed else bisect_left
                i = find(upto, opened + hold)
                if i < len(upto):
                    opened = last[i]

    return lambda batches: _batched(carries(batches), _CARRY)


def mark_openers(
    df: DataFrame,
    keys: list[str],
    time: str,
    ties: list[str],
    hold_s: str,
    *,
    closed: bool,
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Adds ``is_opener`` and ``opened_at``, the time of the opener a row falls under.

    ``hold_s`` names the column of hold seconds, constant per key. A row at
    distance exactly ``hold_s`` is still held when ``closed``, else it opens anew.
    """
    length = resolve(df, keys, time, slice_length)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])
    base = df.select(
        "*",
        key.alias(_KEY),
        axis(df, time).alias(_AT),
        (F.col(hold_s).cast("double") * MICROS).cast("long").alias(_HOLD),
    )
    if length is None:
        ready = base.withColumn(SLICE, F.lit(0).cast("long")).withColumn(
            _INCOMING, F.lit(None).cast("long")
        )
    else:
        # Two scans follow over rows that are derived themselves, so they are stored once.
        cut = session.cut(base).withColumn(SLICE, slice_of(F.col(_AT), length))
        effects = (
            cut.select(_KEY, SLICE, _AT, _HOLD)
            .repartition(_KEY, SLICE)
            .sortWithinPartitions(_KEY, SLICE, _AT)
            .mapInArrow(
                _transfer(closed, length),
                f"{_KEY} string, {SLICE} long, {_HOLD} long, _upto array<long>, _last array<long>",
            )
        )
        carry = (
            effects.repartition(_KEY)
            .sortWithinPartitions(_KEY, SLICE)
            .mapInArrow(_fold_slices(closed), f"{_KEY} string, {SLICE} long, {_INCOMING} long")
        )
        ready = cut.join(carry, [_KEY, SLICE], "left").select(*cut.columns, _INCOMING)
    schema = T.StructType(
        ready.schema.fields
        + [T.StructField("_opened", T.LongType()), T.StructField("is_opener", T.BooleanType())]
    )
    ordered = ready.repartition(_KEY, SLICE).sortWithinPartitions(_KEY, SLICE, _AT, *ties)
    marked = ordered.mapInArrow(_scan(closed), schema)
    opened = F.timestamp_micros("_opened").cast(df.schema[time].dataType)
    return marked.select(*df.columns, "is_opener", opened.alias("opened_at"))
