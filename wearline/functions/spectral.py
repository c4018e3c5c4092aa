"""Frequency-domain features of sample arrays, as one Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Band edges as fractions of the Nyquist frequency, coefficient
# count, and the guard added before logarithms.
BAND_EDGES = (0.0, 0.1, 0.3, 0.5)
CEPSTRAL_COUNT = 5
GUARD = 1e-12

BANDS = ["band_low_energy", "band_mid_energy", "band_high_energy"]
FEATURES = [
    "dominant_freq_hz",
    "spectral_energy",
    "spectral_entropy",
    *BANDS,
    *[f"cepstral_{i}" for i in range(CEPSTRAL_COUNT)],
]
RESULT = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])


def _block(signals: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Features of equally long signals, one row each, in ``FEATURES`` order."""
    count, n = signals.shape
    spectrum = np.fft.rfft(signals - signals.mean(axis=1, keepdims=True), axis=1)
    magnitude = np.abs(spectrum)
    power = magnitude**2
    step = np.arange(power.shape[1]) / n  # frequency as a share of the sampling rate
    energy = power.sum(axis=1)
    flat = energy <= GUARD
    share = np.where(
        flat[:, None], 1.0 / power.shape[1], power / np.where(flat, 1.0, energy)[:, None]
    )
    out = np.zeros((count, len(FEATURES)))
    out[:, 0] = step[power.argmax(axis=1)] * rate
    out[:, 1] = energy
    out[:, 2] = -(share * np.log(share + GUARD)).sum(axis=1)
    hertz = step[None, :] * rate[:, None]
    nyquist = rate[:, None] / 2.0
    for i in range(3):
        inside = (hertz >= BAND_EDGES[i] * nyquist) & (hertz < BAND_EDGES[i + 1] * nyquist)
        out[:, 3 + i] = (power * inside).sum(axis=1)
    cepstrum = np.fft.irfft(np.log(magnitude + GUARD), n=n, axis=1)[:, :CEPSTRAL_COUNT]
    out[:, 6 : 6 + cepstrum.shape[1]] = cepstrum
    return out


@F.pandas_udf(RESULT)
def spectral_features(samples: pd.Series, rate_hz: pd.Series) -> pd.DataFrame:
    """Power-spectrum and cepstrum features; arrays of one length go through one FFT call."""
    out = np.full((len(samples), len(FEATURES)), np.nan)
    lengths = np.array([0 if s is None else len(s) for s in samples], dtype=int)
    rates = rate_hz.to_numpy(dtype=float)
    for n in np.unique(lengths[lengths > 1]):
        rows = np.flatnonzero(lengths == n)
        stacked = np.stack([np.asarray(samples.iloc[i], dtype=float) for i in rows])
        out[rows] = _block(stacked, rates[rows])
    return pd.DataFrame(out, columns=FEATURES)


def register(spark: SparkSession) -> None:
    """Makes ``spectral_features(array<double>, double)`` callable from SQL."""
    spark.udf.register("spectral_features", spectral_features)


def with_spectral(
    df: DataFrame,
    rate_hz: float,
    *,
    sensors: list[str] | None = None,
    min_samples: int = 32,
    samples: str = "samples",
) -> DataFrame:
    """Spectral columns for rows on the sensor list that hold enough samples."""
    if rate_hz <= 0:
        raise ValueError(f"sampling rate must be positive, got {rate_hz}")
    if min_samples < 4:
        raise ValueError(f"min_samples must be at least 4, got {min_samples}")
    kept = df.where(F.size(samples) >= min_samples)
    if sensors is not None:
        kept = kept.where(F.col("sensor").isin(list(sensors)))
    kept = kept.withColumn(
        "_spectral", spectral_features(F.col(samples).cast("array<double>"), F.lit(float(rate_hz)))
    )
    return kept.select(*df.columns, "_spectral.*")
