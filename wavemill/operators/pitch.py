"""Pitch by the cumulative mean normalised difference function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.frames import frame
from wavemill.operators.spectral import map_frames


def track(v: np.ndarray, sr: float, f_min: float, f_max: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and confidence of each frame (a row); 0, 0 where there is none in range."""
    n = v.shape[1]
    low, high = max(1, int(sr / f_max)), min(n // 2, int(sr / f_min) + 1)
    size = n - high - 1
    diff = np.stack([((v[:, :size] - v[:, lag : lag + size]) ** 2).sum(axis=1) for lag in range(high + 1)], axis=1)
    run = np.cumsum(diff[:, 1:], axis=1)
    norm = np.ones_like(diff)
    norm[:, 1:] = np.where(run > 0, diff[:, 1:] * np.arange(1, high + 1) / np.where(run > 0, run, 1), 1.0)
    inner, rows = norm[:, low:high], np.arange(len(v))
    dips = (inner < threshold) & (inner <= norm[:, low + 1 : high + 1]) & (inner <= norm[:, low - 1 : high - 1])
    lowest = low + norm[:, low : high + 1].argmin(axis=1)
    lag = np.where(dips.any(axis=1), low + dips.argmax(axis=1), np.where(norm[rows, lowest] < 0.5, lowest, 0)) if high > low else np.where(norm[rows, lowest] < 0.5, lowest, 0)
    a, b, c = norm[rows, np.maximum(lag - 1, 0)], norm[rows, lag], norm[rows, np.minimum(lag + 1, high)]
    bend = a - 2 * b + c
    bent = (lag > 0) & (lag < high) & (np.abs(bend) > 1e-10)
    at = lag + np.where(bent, 0.5 * (a - c) / np.where(bent, bend, 1), 0)
    f = np.where(lag > 0, sr / np.where(at > 0, at, 1), 0)
    found = (lag > 0) & (f >= f_min) & (f <= f_max)
    return np.where(found, f, 0.0), np.where(found, 1 - b, 0.0)


def pitches(clips: DataFrame, sr: float = 22050, length: int = 2048, hop: int = 512, f_min: float = 65.0, f_max: float = 2093.0, threshold: float = 0.1, padded: bool = True) -> DataFrame:
    """(clip_id, t, pitch, confidence) of arrays or of tall samples. Clips shorter than a frame have no rows."""
    if "y" in clips.columns:
        long_enough = clips.where(F.size("y") >= length)
    else:
        long_enough = clips.join(clips.groupBy("clip_id").agg(F.max("n").alias("n_")).where(F.col("n_") + 1 >= length).select("clip_id"), "clip_id", "left_semi")
    frames = frame(long_enough, length, hop, length // 2 if padded else 0, "reflect")

    def step(v: np.ndarray) -> tuple[np.ndarray, ...]:
        return (np.stack(track(v, sr, f_min, f_max, threshold), axis=1),)

    return map_frames(frames, "v", ["p_"], step).select("clip_id", "t", F.col("p_")[0].alias("pitch"), F.col("p_")[1].alias("confidence"))
