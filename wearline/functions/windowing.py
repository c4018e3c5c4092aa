"""Window statistics of one buffered sensor, for stream processors."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import sqrt

import numpy as np

MICROS = 1_000_000


def window_bounds(times: list[int], at: int, window_s: int) -> tuple[int, int]:
    """Index range of ``[at - window, at]`` in a time-sorted buffer."""
    return bisect_left(times, at - window_s * MICROS), bisect_right(times, at)


def statistics(samples: list[float]) -> dict[str, float]:
    """The eight rolling statistics of at least two samples, oldest first."""
    v = np.array(samples)
    n = len(samples)
    ordered = np.sort(v)
    mean = float(v.sum()) / n
    off = v - mean
    middle = n // 2
    median = ordered[middle] if n % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    return {
        "mean": mean,
        "std": sqrt(float(off.dot(off)) / n),
        "min": float(ordered[0]),
        "max": float(ordered[-1]),
        "median": float(median),
        "rms": sqrt(float(v.dot(v)) / n),
        "range": float(ordered[-1] - ordered[0]),
        "rate_of_change": float(np.abs(v[1:] - v[:-1]).sum()) / (n - 1),
    }
