"""Per-key ordered computations that survive a key holding a third of all rows.

A plain ``Window.partitionBy(machine)`` sends one machine to one task. The
helpers here first measure the largest key. While every key is below
``ROWS_PER_SLICE`` the plain window is used. Beyond it the order axis of all
keys is cut into slices, and ``(key, slice)`` becomes the partition:

* bounded look-back frames copy the look-back rows into the following slice
  (``with_lookback``), and
* unbounded running values add a carry computed from one partial aggregate per
  slice (``running``), the usual two-level prefix scan.

Both give the same values as the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import session
from wearline.operators.lookups import join_null_safe, sized

ROWS_PER_SLICE = 2_000_000
ROWS_SETTING = "wearline.rowsPerSlice"
SLICE = "_slice"
HOME = "_home"
AUTO = "auto"
_HISTOGRAM_BINS = 4096
_TIMELESS = -(1 << 62)


def axis(df: DataFrame, name: str) -> Column:
    """The order column as a long: microseconds for times, itself for integers."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_SETTING, str(ROWS_PER_SLICE)))


def slice_length(df: DataFrame, keys: list[str], order: str, rows: int | None = None) -> int | None:
    """Axis length of a slice holding about ``rows`` rows of the busiest key.

    ``None`` means every key fits, so no slicing is needed. Two aggregates over
    the key and order columns only; a single row reaches the driver.
    """
    limit = rows or rows_per_slice(df)
    slim = df.select(*keys, axis(df, order).alias("_axis"))
    sizes = slim.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_axis").alias("lo"), F.max("_axis").alias("hi")
    )
    top = sizes.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if top["n"] is None or top["n"] <= limit or top["lo"] is None:
        return None
    bin_length = max(1, (top["hi"] - top["lo"] + 1) // _HISTOGRAM_BINS)
    peak = (
        slim.groupBy(*keys, F.floor(F.col("_axis") / F.lit(bin_length)).alias("_bin"))
        .agg(F.count("*").alias("n"))
        .agg(F.max("n"))
        .first()[0]
    )
    return max(1, int(bin_length * limit / peak))


def resolve(df: DataFrame, keys: list[str], order: str, length: int | None | str) -> int | None:
    return slice_length(df, keys, order) if length == AUTO else length


def slice_of(position: Column, length: int) -> Column:
    return F.floor(position / F.lit(length)).cast("long")


def with_slice(df: DataFrame, order: str, length: int | None) -> DataFrame:
    """Adds ``_slice`` (constant zero when unsliced)."""
    if length is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    return df.withColumn(SLICE, slice_of(axis(df, order), length))


def with_lookback(df: DataFrame, order: str, length: int | None, lookback: int) -> DataFrame:
    """Each row in its own slice, plus copies in the slices whose frames reach back to it.

    Compute over ``keys + _slice`` and keep rows where ``_slice = _home``. The
    slice is never shorter than the look-back, so a row has at most one copy.
    Rows without a time share a slice of their own, as they share a frame unsliced.
    """
    if length is None:
        return with_slice(df, order, None).withColumn(HOME, F.lit(0).cast("long"))
    length = max(length, lookback)
    at = axis(df, order)
    home = F.coalesce(slice_of(at, length), F.lit(_TIMELESS))
    last = F.coalesce(slice_of(at + F.lit(lookback), length), F.lit(_TIMELESS))
    return df.withColumn(HOME, home).withColumn(SLICE, F.explode(F.sequence(home, last)))


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``count``, ``min``, ``max`` or ``last`` (non-null)."""

    name: str
    kind: str
    value: Column

    def whole(self, order: list[str]) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.kind](self.value)

    def over(self, window) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        fn = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.kind]
        return fn(self.value).over(window)

    def of_partials(self, partial: Column) -> Column:
        if self.kind == "last":
            return F.last(partial, ignorenulls=True)
        return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[self.kind](partial)

    def merge(self, carry: Column, own: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(own, carry)
        if self.kind == "count":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
        if self.kind == "sum":
            return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
        return {"min": F.least, "max": F.greatest}[self.kind](carry, own)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[Running],
    *,
    include_current: bool = True,
    slice_length: int | None | str = AUTO,
    store: bool = False,
) -> DataFrame:
    """Adds running values per key over all earlier rows (and the current one).

    ``order`` names ascending columns; the first is the slicing axis and the
    whole list must order rows of a key totally. The sliced form reads its input
    twice: set ``store`` for an input that is itself costly, and it is written
    to reliable storage once; a plain scan is cheaper to repeat.
    """
    length = resolve(df, keys, order[0], slice_length)
    end = 0 if include_current else -1
    if length is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[v.over(window).alias(v.name) for v in values])

    cut = with_slice(session.cut(df) if store else df, order[0], length)
    partial = cut.groupBy(*keys, SLICE).agg(*[v.whole(order).alias(f"_p_{v.name}") for v in values])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = partial.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        *[v.of_partials(F.col(f"_p_{v.name}")).over(before).alias(f"_c_{v.name}") for v in values],
    )
    match = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = cut.join(carry, match, "left")
    window = (
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[v.merge(F.col(f"_c_{v.name}"), v.over(window)).alias(v.name) for v in values],
    )


def with_cycle(
    df: DataFrame, keys: list[str], order: list[str], name: str = "cycle", **kw
) -> DataFrame:
    """1-based position of a row within its key."""
    return running(df, keys, order, [Running(name, "count", F.lit(1))], **kw)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], **kw
) -> DataFrame:
    """Values of the preceding row of the key (null stays null, as ``lag``)."""
    boxed = [Running(f"_prev_{n}", "last", F.struct(v.alias("v"))) for n, v in columns.items()]
    out = running(df, keys, order, boxed, include_current=False, **kw)
    return out.select(*df.columns, *[F.col(f"_prev_{n}.v").alias(n) for n in columns])


def with_key_aggregates(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Joins per-key aggregates back, instead of a whole-partition window.

    The aggregate combines map-side. With few keys it is broadcast; with many,
    adaptive execution splits a skewed join partition. A hot key costs no single task.
    Rows with a null key form a group like any other.
    """
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return join_null_safe(df, sized(totals), keys)
