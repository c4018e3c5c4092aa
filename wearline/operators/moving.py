"""Moving statistics whose work per row does not grow with the window.

Rows arrive sorted by key and time after one shuffle. A task reads them batch by
batch and keeps only the rows that the longest window of the current key still
reaches. All frames of a batch are computed at once on arrays:

* blocks of 1, 2, 4, ... rows are aggregated by doubling. A frame is the sum of
  one block for each bit of its size, so mean, deviation, rms, change and
  covariance come from the frame's own rows by stable merges, without the
  cancellation of prefix sums; two blocks cover a frame for its extremes,
* medians come from a wavelet matrix over the values' ranks, one step per bit.

The work per row is the logarithm of the frame's size. Null values do not count;
NaN and infinities give what Spark's aggregates give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wearline.operators.slices import HOME, SLICE, axis, with_lookback

AT = "_at"
MICROS = 1_000_000
#: Work waits for at least this many rows, and for as many as are carried over.
LEAST_ROWS = 1 << 15
_WIDEST = 1 << 61


# --- frames ------------------------------------------------------------------


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before (nulls are alike, as in a grouping)."""
    n = len(column)
    out = np.ones(n, bool)
    if n > 1:
        before, after = column.slice(0, n - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(before, after), False)
        nulls = pc.xor(before.is_null(), after.is_null())
        out[1:] = pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    return out


class Frames:
    """First and past-the-last row of every row's window ``[t - w, t]`` among sorted keys and times.

    ``groups`` numbers the keys in order. All windows are found by one search
    over times that are shifted apart by key.
    """

    def __init__(self, groups: np.ndarray, times: np.ndarray, longest: int):
        self.n = n = len(times)
        first = np.flatnonzero(np.diff(groups, prepend=-1))
        self.start = np.repeat(first, np.diff(np.append(first, n)))
        since = times - times[self.start]
        spans = since[np.append(first[1:], n) - 1] + (longest + 1)
        if spans.sum(dtype=np.float64) > _WIDEST:
            raise OverflowError("the keys' times do not fit one axis")
        self.place = since + np.repeat(np.cumsum(spans) - spans, np.diff(np.append(first, n)))
        self.high = np.searchsorted(self.place, self.place, side="right")

    def low(self, window: int) -> np.ndarray:
        return np.maximum(np.searchsorted(self.place, self.place - window, side="left"), self.start)


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Count, means and central second moments of two sets of rows together.

    A state is the count, then one mean per column, then the moments of all
    column pairs (each with itself first): 3 arrays for one column, 6 for two.
    """
    n = a[0] + b[0]
    columns = 1 if len(a) == 3 else 2
    share = b[0] / np.maximum(n, 1)
    weight = a[0] * share
    steps = [b[1 + i] - a[1 + i] for i in range(columns)]
    means = [a[1 + i] + steps[i] * share for i in range(columns)]
    pairs = [(0, 0)] if columns == 1 else [(0, 0), (1, 1), (0, 1)]
    at = 1 + columns
    moments = [a[at + k] + b[at + k] + steps[i] * steps[j] * weight for k, (i, j) in enumerate(pairs)]
    return [n, *means, *moments]


def folded(rows: list[np.ndarray], merge: Callable, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The rows ``low`` to ``high`` merged, for each frame; an empty frame has the state of zeros."""
    size, at = high - low, low.copy()
    out = [np.zeros(len(low), r.dtype) for r in rows]
    block, width = rows, 1
    for p in range(int(size.max(initial=0)).bit_length()):
        width = 1 << p
        own = np.flatnonzero(size >> p & 1)
        if len(own):
            first = at[own]
            for o, merged in zip(out, merge([o[own] for o in out], [b[first] for b in block])):
                o[own] = merged
            at[own] += width
        if len(block[0]) > width:
            block = merge([b[:-width] for b in block], [b[width:] for b in block])
    return out


def extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, best: Callable) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of ``values[low:high]`` for each pair; no frame is empty."""
    size = high - low
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    block = values
    for p in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == p)
        if len(at):
            out[at] = best(block[low[at]], block[high[at] - (1 << p)])
        if len(block) > 1 << p:
            block = best(block[: len(block) - (1 << p)], block[1 << p :])
    return out


class Selection:
    """The k-th smallest of any stretch of rows: a wavelet matrix over the ranks of the values."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.sorted = values[order]
        self.planes = []
        for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
            zero = (ranks >> bit & 1) == 0
            self.planes.append(_counts(zero))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones before it among rows ``low`` to ``high``."""
        low, high, k = low.copy(), high.copy(), k.copy()
        rank = np.zeros(len(low), np.int64)
        for zeros in self.planes:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            rank = rank << 1 | one
            k = np.where(one, k - (b - a), k)
            total = zeros[-1]
            low = np.where(one, total + low - a, a)
            high = np.where(one, total + high - b, b)
        return self.sorted[rank]


# --- statistics ----------------------------------------------------------------


class Column:
    """One value column and the frames' aggregates of it, each computed when first asked for."""

    def __init__(self, values: np.ndarray, valid: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray):
        self.valid, self.values = valid, np.where(valid, values, 0.0)
        self.low, self.high, self.first = low, high, first
        counted = _counts(valid)
        self.count = counted[high] - counted[low]
        self.n = np.maximum(self.count, 1)

    @cached_property
    def sums(self) -> np.ndarray:
        return folded([self.values], _added, self.low, self.high)[0]

    @cached_property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @cached_property
    def std(self) -> np.ndarray:
        rows = [self.valid.astype(np.float64), self.values, np.zeros(len(self.values))]
        moment = folded(rows, _merged, self.low, self.high)[2]
        return np.where(np.isfinite(self.sums), np.sqrt(moment / self.n), np.nan)

    @cached_property
    def rms(self) -> np.ndarray:
        return np.sqrt(folded([self.values * self.values], _added, self.low, self.high)[0] / self.n)

    @cached_property
    def min(self) -> np.ndarray:
        """NaN is greater than any number."""
        number = self.valid & ~np.isnan(self.values)
        numbers = _counts(number)
        found = extremes(np.where(number, self.values, np.inf), self.low, self.high, np.minimum)
        return np.where(numbers[self.high] > numbers[self.low], found, np.nan)

    @cached_property
    def max(self) -> np.ndarray:
        return extremes(np.where(self.valid, self.values, -np.inf), self.low, self.high, np.maximum)

    @cached_property
    def range(self) -> np.ndarray:
        return self.max - self.min

    @cached_property
    def ranked(self) -> tuple[np.ndarray, Selection]:
        """Values by rank, NaN and then nulls last, and the selection among the ranks."""
        keyed = np.where(self.valid, self.values, np.nan)
        order = np.lexsort((~self.valid, keyed))
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return keyed[order], Selection(ranks)

    @cached_property
    def median(self) -> np.ndarray:
        values, selection = self.ranked
        below = np.maximum(self.count - 1, 0) // 2
        a, b = (values[selection.smallest(self.low, self.high, k)] for k in (below, self.count // 2))
        return np.where(self.count % 2 == 1, a, 0.5 * a + 0.5 * b)

    @cached_property
    def rate_of_change(self) -> np.ndarray:
        """Mean absolute step from row to row; the first row's step reaches outside the frame."""
        step = np.zeros(len(self.values))
        known = self.valid[1:] & self.valid[:-1] & (self.first[1:] == self.first[:-1])
        step[1:] = np.where(known, np.abs(self.values[1:] - self.values[:-1]), 0.0)
        total = folded([step], _added, np.minimum(self.low + 1, self.high), self.high)[0]
        return total / np.maximum(self.count - 1, 1)


def pearson(a: Column, b: Column, least: int, constant_below: float, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of two columns over the rows that hold both values, and the mask of frames without one."""
    # extended precision, so that the quotient is the exact one rounded once
    both = np.ones(len(a.valid), bool) if aligned else a.valid & b.valid
    x, y = ((c.values if aligned else np.where(both, c.values, 0.0)).astype(np.longdouble) for c in (a, b))
    both, zero = both.astype(np.longdouble), np.zeros(len(both), np.longdouble)
    n, mean_x, mean_y, xx, yy, xy = folded([both, x, y, zero, zero, zero], _merged, a.low, a.high)
    m = np.maximum(n, 1)
    # a spread that is not a number counts as one: the result is then not a number
    spread_x, spread_y = np.sqrt(xx / m), np.sqrt(yy / m)
    unusable = (n < least) | (spread_x < constant_below) | (spread_y < constant_below)
    return (xy / m / (spread_x * spread_y)).astype(np.float64), unusable


# --- running over sorted rows -------------------------------------------------------


def _numbers_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks().cast(pa.float64())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), valid


class _Rows:
    """Feeds whole frames to ``work``: rows that are complete, and before them those their windows reach."""

    def __init__(self, keys: list[str], longest: int, work: Callable):
        self.keys, self.longest, self.work = keys, longest, work
        self.carried: pa.Table | None = None
        self.done = 0

    def feed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(LEAST_ROWS, self.carried.num_rows if self.carried is not None else 0):
                yield from self._step(waiting, False)
                waiting, rows = [], 0
        if waiting or self.carried is not None:
            yield from self._step(waiting, True)

    def _step(self, batches: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if batches else self.carried.slice(0, 0)
        if self.carried is not None:
            table = pa.concat_tables([self.carried, table])
        table = table.combine_chunks()
        n = table.num_rows
        if not n:
            return
        at = table.column(AT).combine_chunks()
        absent = at.is_null().to_numpy(zero_copy_only=False)
        times = at.fill_null(0).to_numpy(zero_copy_only=False)
        change = np.ones(n, bool)
        change[1:] = absent[1:] != absent[:-1]
        for key in self.keys:
            change |= _changes(table.column(key).combine_chunks())
        groups = np.cumsum(change) - 1
        end = n
        if not last:
            # rows at the last time of the last key may have further ones after them
            end = int(np.flatnonzero((groups == groups[-1]) & (times == times[-1]))[0])
        if end > self.done:
            for low, high in self._parts(groups, times, n):
                first, past = max(low, self.done), min(high, end)
                if first < past:
                    frames = Frames(groups[low:high], times[low:high], self.longest)
                    yield from self.work(table.slice(low, high - low), frames, first - low, past - low)
        start = int(np.searchsorted(groups, groups[-1]))
        keep = start + int(np.searchsorted(times[start:], times[-1] - self.longest))
        keep = min(keep, end)
        self.done = max(end, self.done) - keep
        # a copy, so the slice does not hold the whole table
        self.carried = None if last else table.take(pa.array(np.arange(keep, n)))

    def _parts(self, groups: np.ndarray, times: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Stretches of whole keys whose times fit one axis."""
        first = np.flatnonzero(np.diff(groups, prepend=-1))
        last = np.append(first[1:], n) - 1
        spans = (times[last] - times[first]).astype(np.float64) + self.longest + 1
        part = (np.cumsum(spans) // (_WIDEST / 4)).astype(np.int64)
        cuts = first[np.flatnonzero(np.diff(part, prepend=-1))].tolist()
        yield from zip(cuts, [*cuts[1:], n])


def _sorted_rows(df: DataFrame, keys: list[str], order: list[str], length: int | None, longest: int) -> DataFrame:
    """Rows by key and time, each key (or slice of one, with the rows its frames reach) in one task."""
    base = with_lookback(df, order[0], length, longest).withColumn(AT, axis(df, order[0]))
    by = [*keys, SLICE]
    return base.repartition(*by).sortWithinPartitions(*by, AT, *order[1:])


def _home(table: pa.Table, first: int, past: int) -> np.ndarray:
    """Places of the rows that are not copies for a later slice."""
    part = table.slice(first, past - first)
    same = pc.equal(part.column(SLICE), part.column(HOME)).to_numpy()
    return np.flatnonzero(same) + first


def moving_statistics(
    df: DataFrame,
    windows_s: list[int],
    stats: list[str],
    *,
    keys: list[str],
    order: list[str],
    value: str,
    min_rows: int,
    length: int | None,
) -> DataFrame:
    """``df``'s columns with ``window_s``, ``n`` and the statistics, one row per reading and window."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("window_s", T.IntegerType()), T.StructField("n", T.LongType())])
    for s in stats:
        schema = schema.add(s, T.DoubleType())

    def work(table, frames, first, past):
        values, rows = _numbers_of(table, value), _home(table, first, past)
        for w in windows_s:
            low, high = frames.low(w * MICROS)[rows], frames.high[rows]
            column = Column(*values, low, high, frames.start)
            kept = np.flatnonzero(column.count >= min_rows)
            if not len(kept):
                continue
            taken = table.select(names).take(pa.array(rows[kept])).combine_chunks()
            arrays = [taken.column(c).combine_chunks() for c in names]
            arrays += [pa.array(np.full(len(kept), w, np.int32)), pa.array(column.count[kept])]
            with np.errstate(all="ignore"):
                for s in stats:
                    empty = column.count[kept] < (2 if s == "rate_of_change" else 1)
                    arrays.append(pa.array(getattr(column, s)[kept], pa.float64(), mask=empty))
            yield pa.record_batch(arrays, names=schema.names)

    longest = max(windows_s) * MICROS
    rows = _sorted_rows(df, keys, order, length, longest)
    return rows.mapInArrow(lambda batches: _Rows([*keys, SLICE], longest, work).feed(batches), schema)


def moving_pearson(
    df: DataFrame,
    pairs: list[tuple[str, str]],
    window_s: int,
    *,
    keys: list[str],
    order: str,
    min_samples: int,
    constant_below: float,
    aligned: bool,
    length: int | None,
) -> DataFrame:
    """``df``'s columns with ``{a}_x_{b}_pearson`` per pair, over the rows that hold both values."""
    names = df.columns
    schema = T.StructType(list(df.schema.fields))
    for a, b in pairs:
        schema = schema.add(f"{a}_x_{b}_pearson", T.DoubleType())
    sensors = sorted({s for pair in pairs for s in pair})

    def work(table, frames, first, past):
        rows = _home(table, first, past)
        if not len(rows):
            return
        low, high = frames.low(window_s * MICROS)[rows], frames.high[rows]
        columns = {s: Column(*_numbers_of(table, s), low, high, frames.start) for s in sensors}
        taken = table.select(names).take(pa.array(rows)).combine_chunks()
        arrays = [taken.column(c).combine_chunks() for c in names]
        with np.errstate(all="ignore"):
            for a, b in pairs:
                found, empty = pearson(columns[a], columns[b], min_samples, constant_below, aligned)
                arrays.append(pa.array(found, pa.float64(), mask=empty))
        yield pa.record_batch(arrays, names=schema.names)

    longest = window_s * MICROS
    rows = _sorted_rows(df, keys, [order], length, longest)
    return rows.mapInArrow(lambda batches: _Rows([*keys, SLICE], longest, work).feed(batches), schema)
