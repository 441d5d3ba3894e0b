"""Separation and factorisation: harmonic and percussive parts, non-negative factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.arrays import total
from wavemill.operators.blocks import matrix, over_frames, rows_of, sliding_median, typed
from wavemill.operators.features import tall_values, wide
from wavemill.operators.lineage import cut
from wavemill.operators.spectral import apply_filterbank, map_frames


def hpss_frames(magnitudes: DataFrame, time_size: int = 31, freq_size: int = 31, power: float = 2.0, eps: float = 1e-10) -> DataFrame:
    """(clip_id, t, harmonic, percussive): soft masks from medians along time and along frequency, arrays over the bins.

    Median windows are cut off at the ends and take the upper of two middles. Frames meet in blocks with half a window around them, so
    each is shuffled about once and no clip is an array.
    """
    half = time_size // 2

    def work(clip: pa.Array, t: np.ndarray, v: np.ndarray, mine: slice) -> pa.RecordBatch:
        g, size, bins = v.shape
        own = v[:, mine]
        h = sliding_median(np.swapaxes(v, 0, 1), half)[mine].swapaxes(0, 1) ** power
        p = np.moveaxis(sliding_median(np.moveaxis(own, 2, 0), freq_size // 2), 0, 2) ** power
        n = own.shape[1]
        flat = [(x / (h + p + eps)).reshape(g * n, bins) for x in (h, p)]
        return pa.RecordBatch.from_arrays([clip.take(pa.array(np.repeat(np.arange(g), n))), pa.array(t[:, mine].ravel().astype(np.int32)), *map(rows_of, flat)], names=["clip_id", "t", "harmonic", "percussive"])

    return over_frames(magnitudes, max(64, 16 * half), half, half, work, f"{typed(magnitudes, ['clip_id'])}, t int, harmonic array<double>, percussive array<double>")


def hpss(magnitudes: DataFrame, time_size: int = 31, freq_size: int = 31, power: float = 2.0, eps: float = 1e-10) -> DataFrame:
    """(clip_id, t, f, harmonic, percussive): the masks of ``hpss_frames``, a row a value."""
    rows = hpss_frames(magnitudes, time_size, freq_size, power, eps).select("clip_id", "t", F.posexplode(F.arrays_zip("harmonic", "percussive")).alias("f", "z"))
    return rows.select("clip_id", "t", "f", "z.harmonic", "z.percussive")


def apply_mask(frames: DataFrame, mask: DataFrame, column: str) -> DataFrame:
    """Frames times a tall mask."""
    made = tall_values(frames).join(mask.select("clip_id", "t", "f", F.col(column).alias("m_")), ["clip_id", "t", "f"])
    return wide(made.select("clip_id", "t", "f", (F.col("x") * F.col("m_")).alias("x")))


@dataclass
class Factors:
    """basis (k, features), activations (clip_id, t, v of length k), and the Frobenius norm of what is left after every round."""

    basis: np.ndarray
    activations: DataFrame
    errors: list[float]


def first_basis(n_features: int, k: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).random((k, n_features)) + 0.1


def nmf(
    frames: DataFrame, n_features: int, k: int, iterations: int = 200, tolerance: float = 1e-4, seed: int = 1, alpha: float = 0.0, l1: tuple[float, float] = (0.0, 0.0), basis: np.ndarray | None = None, keep: int = 5, eps: float = 1e-10
) -> Factors:
    """Non-negative factors of frames (clip_id, t, v) by multiplicative updates, until the error changes by less than ``tolerance`` of itself.

    Each round is one pass: activations are brought up to date row by row, and three sums meet on the driver, k by features, k by k and
    one number, whatever the number of frames. They give the new basis and, without another pass, its error. Activations are kept
    with their frames in the shared folder every ``keep`` rounds; in between a pass makes the few updates since then again. ``l1``: shares
    of ``alpha`` that shrink basis and activations. A frame's activations start even, from its own mean.
    """
    basis = first_basis(n_features, k, seed) if basis is None else np.asarray(basis, dtype=float)
    level = float(basis.mean()) * k
    names = [c for c in frames.columns if c != "v"]

    def updated(v: np.ndarray, h: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
        for b in bases:
            h = np.maximum(eps, h * (v @ b.T) / (h @ (b @ b.T) + eps) / (1 + alpha * l1[1]))
        return h

    def activated(state: DataFrame, bases: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v, h = (matrix(batch.column(batch.schema.get_field_index(c))) for c in ("v", "h"))
                    kept = [batch.column(batch.schema.get_field_index(c)) for c in (*names, "v")]
                    yield pa.RecordBatch.from_arrays([*kept, rows_of(updated(v, h, bases))], names=[*names, "v", "h"])

        return state.mapInArrow(run, f"{typed(frames, names)}, v array<double>, h array<double>")

    def sums(state: DataFrame, bases: list[np.ndarray]) -> np.ndarray:
        size = k * n_features + k * k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    v, h = matrix(batch.column(0)), matrix(batch.column(1))
                    h = updated(v, h, bases)
                    out += np.concatenate([(h.T @ v).ravel(), (h.T @ h).ravel(), [(v * v).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["i", "x"])

        flat = np.zeros(size)
        for r in state.select("v", "h").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            flat[r["i"]] = r["x"]
        return flat

    start = frames.withColumn("v", F.col("v").cast("array<double>")).withColumn("h", F.expr(f"array_repeat({total('v')} / size(v) / {level!r}D, {k})"))
    state, pending, errors = cut(start.select(*names, "v", "h")), [], []
    for _ in range(iterations):
        if len(pending) == keep:
            state, pending = cut(activated(state, pending)), []
        pending.append(basis)
        flat = sums(state, pending)
        num, gram, square = flat[: k * n_features].reshape(k, n_features), flat[k * n_features : -1].reshape(k, k), flat[-1]
        basis = np.maximum(eps, basis * num / (gram @ basis + eps) / (1 + alpha * l1[0]))
        errors.append(math.sqrt(max(0.0, square - 2 * (basis * num).sum() + ((basis @ basis.T) * gram).sum())))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) / (errors[-2] + eps) < tolerance:
            break
    return Factors(basis, activated(state, pending).select(*names, F.col("h").alias("v")), errors)


def nmf_reconstruct(activations: DataFrame, basis: np.ndarray, component: int | None = None) -> DataFrame:
    """Frames from activations, all components or one."""
    b = basis if component is None else basis * (np.arange(len(basis)) == component)[:, None]
    return apply_filterbank(activations, b.T)


def nmf_transform(frames: DataFrame, basis: np.ndarray, iterations: int = 100, eps: float = 1e-10) -> DataFrame:
    """Activations of a given basis."""
    def step(v: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.ones((len(v), len(basis)))
        num, gram = v @ basis.T, basis @ basis.T
        for _ in range(iterations):
            a *= num / np.maximum(a @ gram, eps)
        return (a,)

    return map_frames(frames, "v", ["v"], step)
