"""Spectra of frame series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_bands(frames: DataFrame, by: list[str], frame: str, value: str, n_frames: int, bands_per_octave: int = 3) -> DataFrame:
    """(by, band, db): power of the discrete Fourier transform of a key's n_frames values in logarithmic bands; a fixed number of
    frames bounds a group. Missing frames are 0, empty bands are left out, silence gives null."""
    schema = ", ".join([*(f"{k} {frames.schema[k].dataType.simpleString()}" for k in by), "band long, db double"])

    def one(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n_frames)
        x[pdf[frame].to_numpy()] = pdf[value].to_numpy()
        power = np.abs(np.fft.rfft(x * np.hanning(n_frames)))[1:] ** 2
        band = np.floor(bands_per_octave * np.log2(np.arange(1, len(power) + 1)) + 1e-9).astype(int)
        sums, counts = np.bincount(band, power), np.bincount(band)
        return pd.DataFrame([[*keys, b, 10 * np.log10(sums[b] / counts[b]) if sums[b] > 0 else None] for b in np.flatnonzero(counts)], columns=[*by, "band", "db"])

    return frames.where(F.col(frame).between(0, n_frames - 1)).groupBy(*by).applyInPandas(one, schema)
