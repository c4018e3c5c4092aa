"""Sliding windows of one sensor that are kept up reading by reading."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from math import fsum, isfinite, sqrt

from wearline.functions.windowing import MICROS, statistics, window_bounds

STATS = ["mean", "std", "min", "max", "median", "rms", "range", "rate_of_change"]
#: A mean this many deviations away from the centre costs too many digits: the centre is moved.
_FAR = 1e3


class RunningSum:
    """A sum that values can be taken out of again; what rounding loses is carried along."""

    __slots__ = ("total", "lost")

    def __init__(self, values: list[float]):
        self.total = fsum(values)
        self.lost = fsum([*values, -self.total])

    def add(self, x: float) -> None:
        t = self.total + x
        self.lost += (self.total - t) + x if abs(self.total) >= abs(x) else (x - t) + self.total
        self.total = t

    @property
    def value(self) -> float:
        return self.total + self.lost


class View:
    """One window over the shared samples: its first sample, its values in order, and its sums about a centre."""

    def __init__(self, width: int):
        self.width, self.start = width, 0
        self.fill([], 0)

    def fill(self, values: list[float], start: int) -> None:
        self.start, self.ordered = start, sorted(values)
        self.centre = self.ordered[len(values) // 2] if values and isfinite(self.ordered[len(values) // 2]) else 0.0
        off = [v - self.centre for v in values]
        if all(map(isfinite, off)):
            self.first, self.second = RunningSum(off), RunningSum([x * x for x in off])
            self.steps = RunningSum([abs(b - a) for a, b in zip(values, values[1:])])
        else:
            self.first = self.second = self.steps = None

    def add(self, times, values) -> None:
        """Take in the newest sample and let go of those that are too old."""
        value, floor = values[-1], times[-1] - self.width
        odd = self.first is None or not isfinite(value)
        insort(self.ordered, value)
        if not odd:
            off = value - self.centre
            self.first.add(off)
            self.second.add(off * off)
            if len(self.ordered) > 1:
                self.steps.add(abs(value - values[-2]))
        while times[self.start] < floor:
            old = values[self.start]
            del self.ordered[bisect_left(self.ordered, old)]
            if not odd:
                off = old - self.centre
                self.first.add(-off)
                self.second.add(-off * off)
                self.steps.add(-abs(values[self.start + 1] - old))
            self.start += 1
        if odd:
            self.fill(list(values[self.start :]), self.start)

    def statistics(self, values) -> tuple[float, ...]:
        """In the order of ``STATS``, for two samples or more."""
        ordered, n = self.ordered, len(self.ordered)
        if self.first is None:
            found = statistics(list(values[self.start :]))
            return tuple(found[s] for s in STATS)
        low, high, middle = ordered[0], ordered[-1], n // 2
        median = ordered[middle] if n % 2 else (ordered[middle - 1] + ordered[middle]) / 2
        if low == high:
            return (low, 0.0, low, high, low, abs(low), 0.0, 0.0)
        off = self.first.value / n
        variance = self.second.value / n - off * off
        if off * off > _FAR * _FAR * variance:
            self.fill(list(values[self.start :]), self.start)
            off = self.first.value / n
            variance = self.second.value / n - off * off
        square = self.second.value / n + self.centre * (2 * off + self.centre)
        return (
            self.centre + off,
            sqrt(max(variance, 0.0)),
            low,
            high,
            median,
            sqrt(max(square, 0.0)),
            high - low,
            max(self.steps.value, 0.0) / (n - 1),
        )


class SensorWindows:
    """The samples of the longest window, and one view per window.

    A sample in order of time costs a search in the ordered values per window,
    whatever the window's length. One that arrives behind its time is put in its
    place, is answered from the samples themselves, and the views are filled
    again; samples older than ``keep`` have left by then.
    """

    def __init__(self, windows: list[int], keep: int, times: bytes = b"", values: bytes = b""):
        self.times, self.values, self.keep = array("q", times), array("d", values), keep
        self.views = [View(w * MICROS) for w in windows]
        self.dropped = 0
        self._fill()

    def _fill(self) -> None:
        if not self.times:
            return
        for view in self.views:
            start = bisect_left(self.times, self.times[-1] - view.width)
            view.fill(list(self.values[start:]), start)

    def push(self, at: int, value: float) -> None:
        if self.times and at < self.times[-1]:
            place = bisect_right(self.times, at)
            self.times.insert(place, at)
            self.values.insert(place, value)
            self._fill()
            return
        self.times.append(at)
        self.values.append(value)
        for view in self.views:
            view.add(self.times, self.values)
        self._let_go()

    def _let_go(self) -> None:
        stale = min(bisect_left(self.times, self.times[-1] - self.keep), min(v.start for v in self.views))
        # dropped now and then, so that it costs nothing per sample
        if stale > 64 and 2 * stale > len(self.times):
            del self.times[:stale], self.values[:stale]
            for view in self.views:
                view.start -= stale

    def at(self, at: int) -> list[tuple[int, tuple[float, ...] | None, tuple[int, int]]]:
        """For each window that ends at ``at``: samples in it, their statistics (from two on), and where they lie."""
        out = []
        for view in self.views:
            if at == self.times[-1]:
                low, high = view.start, len(self.times)
                found = view.statistics(self.values) if high - low >= 2 else None
            else:
                low, high = window_bounds(self.times, at, view.width // MICROS)
                part = statistics(list(self.values[low:high])) if high - low >= 2 else None
                found = part and tuple(part[s] for s in STATS)
            out.append((high - low, found, (low, high)))
        return out

    def packed(self) -> tuple[bytes, bytes]:
        """The samples that later windows can reach."""
        stale = bisect_left(self.times, self.times[-1] - self.keep) if self.times else 0
        return self.times[stale:].tobytes(), self.values[stale:].tobytes()
