"""Changes of rate and pitch, constant-Q relatives, and joining of overlapping chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.arrays import bound, let, literal, total
from wavemill.operators import blocks, spectral
from wavemill.operators.augment import num


def kaiser(length: int, beta: float) -> np.ndarray:
    """Kaiser window by the power series of its Bessel function."""
    def bessel(x: float) -> float:
        term, out = 1.0, 1.0
        for k in range(1, 40):
            term *= (x / (2 * k)) ** 2
            out += term
        return out

    if length == 1:
        return np.ones(1)
    return np.array([bessel(beta * math.sqrt(max(0.0, 1 - (2 * i / (length - 1) - 1) ** 2))) / bessel(beta) for i in range(length)])


def low_pass(length: int, cutoff: float, beta: float = 8.0) -> np.ndarray:
    """Windowed sinc of unit gain at zero; ``cutoff`` in cycles a sample."""
    n = np.arange(length) - (length - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * kaiser(length, beta)
    return h / h.sum()


def convolve(y: str, taps: np.ndarray):
    """y filtered by symmetric taps, same length, silence beyond the ends."""
    half = len(taps) // 2

    def body(y: str) -> str:
        step = total(f"transform(taps, (w, k) -> case when i + k - {half} between 0 and size({y}) - 1 then w * {y}[i + k - {half}] else 0D end)")
        return let(literal(taps), "taps", f"transform({y}, (x, i) -> {step})")

    return F.expr(bound(y, body))


#: Taps of a phase and shape of the Kaiser window of each quality; fixed values.
QUALITIES = {"low": (8, 5.0), "medium": (16, 6.0), "high": (32, 8.0), "very_high": (64, 10.0)}


@dataclass(frozen=True)
class Polyphase:
    """A rational change of rate: up by one factor, filtered below the lower Nyquist frequency, down by another.

    Of the filter only the taps that meet samples are used, a branch for each phase of the output.
    """

    up: int
    down: int
    taps: np.ndarray

    @classmethod
    def of(cls, sr_from: float, sr_to: float, quality: str = "medium", most: int = 1000) -> Polyphase:
        """Rates that aren't in a ratio of whole numbers up to ``most`` are taken as the nearest one that is."""
        ratio = Fraction(sr_to / sr_from).limit_denominator(most)
        up, down = ratio.numerator, ratio.denominator
        per, beta = QUALITIES[quality]
        return cls(up, down, low_pass(per * up | 1, 0.5 * min(1.0, up / down) / up * 0.9, beta))

    @property
    def reach(self) -> int:
        """Samples on either side that an output needs."""
        return len(self.taps) // 2 // self.up + 1

    def outputs(self, length: int) -> int:
        return length * self.up // self.down

    def __call__(self, x: np.ndarray, start: int, low: int, high: int) -> np.ndarray:
        """Outputs low to high - 1 of a clip of which x is the part from ``start`` on, zeros beyond it."""
        half, per = len(self.taps) // 2, -(-len(self.taps) // self.up)
        branches = np.zeros((self.up, per))
        for phase in range(self.up):
            own = self.taps[phase :: self.up]
            branches[phase, : len(own)] = own
        padded = np.concatenate([np.zeros(per), x, np.zeros(per)])
        out = np.empty(high - low)
        for k in range(low, high, 1 << 16):
            at = np.arange(k, min(high, k + (1 << 16))) * self.down + half
            base = at // self.up - start + per
            near = np.clip(base[:, None] - np.arange(per), 0, len(padded) - 1)  # its ends are zeros
            out[k - low : k - low + len(at)] = self.up * (padded[near] * branches[at % self.up]).sum(axis=1)
        return out


def resample(clips: DataFrame, sr_from: float, sr_to: float, quality: str = "medium") -> DataFrame:
    """(clip_id, y) at another rate by a polyphase filter."""
    if sr_from == sr_to:
        return clips.select("clip_id", "y")
    change = Polyphase.of(sr_from, sr_to, quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [change(np.asarray(y.values), 0, 0, change.outputs(len(y.values))) if y.is_valid else np.zeros(0) for y in batch.column(1)]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), blocks.lists_of(np.concatenate(made), np.array([len(m) for m in made]))], names=["clip_id", "y"])

    return clips.select("clip_id", F.col("y").cast("array<double>")).mapInArrow(run, f"{blocks.typed(clips, ['clip_id'])}, y array<double>")


def resample_blocks(parts: DataFrame, sr_from: float, sr_to: float, quality: str = "medium", size: int = blocks.SAMPLES) -> DataFrame:
    """(clip_id, n, y) at another rate, of blocks (clip_id, n, y) of ``size`` samples of clips of any length; the same outputs as ``resample``.

    An output is made where the sample under it is, from its block and the filter's reach around it.
    """
    change = Polyphase.of(sr_from, sr_to, quality)
    if change.reach > size:
        raise ValueError("the filter reaches over a block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column(1)[k].as_py()
                y, before, after = blocks.cells(batch, k)
                end = b * size + len(y)
                low = -(-b * size * change.up // change.down)
                high = -(-end * change.up // change.down) if len(after) else change.outputs(end)
                if high > low:
                    x = change(np.concatenate([before, y, after]), b * size - len(before), low, high)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([low]), blocks.rows_of(x[None])], names=["clip_id", "n", "y"])

    return blocks.with_neighbours(parts, size, change.reach, change.reach).mapInArrow(run, f"{blocks.typed(parts, ['clip_id'])}, n long, y array<double>")


def to_clips(samples: DataFrame) -> DataFrame:
    """(clip_id, y) from (clip_id, n, x)."""
    return samples.groupBy("clip_id").agg(F.expr("transform(array_sort(collect_list(struct(n, x))), s -> s.x)").alias("y"))


def pitch_shift(clips: DataFrame, semitones: float, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(clip_id, y) higher by ``semitones`` at about the same length: stretched, then read at another rate."""
    rate = 2.0 ** (-semitones / 12)
    return resample(to_clips(spectral.time_stretch(clips, rate, n_fft, hop)), 1.0 / rate, 1.0)


def vqt(clips: DataFrame, sr: float, hop: int, f_min: float, n_bins: int, gamma: float, bins_per_octave: int = 12) -> DataFrame:
    """Variable-Q transform: bandwidths wider by ``gamma`` Hz, so shorter kernels at low frequencies."""
    return spectral.cqt(clips, sr, hop, f_min, n_bins, bins_per_octave, gamma)


def harmonic_cqt(clips: DataFrame, sr: float, hop: int, f_min: float, n_bins: int, harmonics: tuple[float, ...] = (1, 2, 3), bins_per_octave: int = 12) -> DataFrame:
    """(clip_id, t, h, re, im): one constant-Q transform a harmonic, all with the frames of the lowest."""
    q = 1 / (2 ** (1 / bins_per_octave) - 1)
    size = int(math.ceil(sr * q / (f_min * min(harmonics))))
    out = None
    for h in harmonics:
        one = spectral.cqt(clips, sr, hop, f_min * h, n_bins, bins_per_octave, length=size).select("clip_id", "t", F.lit(float(h)).alias("h"), "re", "im")
        out = one if out is None else out.unionByName(one)
    return out


def harmonic_weighted(spectra: DataFrame, weights: dict[float, float]) -> DataFrame:
    """(clip_id, t, f, x): weighted sum of the harmonics' magnitudes."""
    w = F.expr("case h " + " ".join(f"when {float(k)!r}D then {float(v)!r}D" for k, v in weights.items()) + " else 0D end")
    rows = spectra.select("clip_id", "t", w.alias("w"), F.posexplode(F.expr("zip_with(re, im, (a, b) -> sqrt(a * a + b * b))")).alias("f", "m"))
    return rows.groupBy("clip_id", "t", "f").agg(F.sum(F.col("w") * F.col("m")).alias("x"))


def sinusoids(sr: float, hop: int, f_min: float, n_bins: int, bins_per_octave: int = 12) -> np.ndarray:
    """Complex sinusoids of every bin (n_bins, 4 * hop), centred."""
    freqs = f_min * 2.0 ** (np.arange(n_bins) / bins_per_octave)
    n = np.arange(4 * hop) - 2 * hop
    return np.exp(2j * np.pi * freqs[:, None] * n[None, :] / sr)


def inverse_cqt(spectra: DataFrame, sr: float, hop: int, f_min: float, n_bins: int, bins_per_octave: int = 12) -> DataFrame:
    """(clip_id, n, x): windowed sinusoids of every bin and frame, summed where they overlap."""
    wave = sinusoids(sr, hop, f_min, n_bins, bins_per_octave)
    bank = np.concatenate([wave.real, -wave.imag])

    frames = spectral.map_frames(spectra.select("clip_id", "t", F.concat("re", "im").alias("c_")), "c_", ["v"], lambda c: (2 * c @ bank,))
    return spectral.overlap_add(frames, 4 * hop, hop, "hann", 2 * hop)


def resolution(k: str, f_min: float | str, sr: float | str, bins_per_octave: int | str = 12, kind: str = "cq", gamma: float | str = 0.0) -> dict[str, Column]:
    """hz, bandwidth, q, n_fft, octave of a bin k as columns: constant or variable Q, the FFT size a power of two. Parameters are numbers or SQL of columns."""
    per, f = f"cast({bins_per_octave} as double)", f"({num(f_min)} * power(2D, {k} / cast({bins_per_octave} as double)))"
    width = f"({f} * (power(2D, 1 / {per}) - 1) / {per}{f' + {num(gamma)}' if kind == 'vqt' else ''})"
    sql = {"hz": f, "bandwidth": width, "q": f"{f} / {width}", "n_fft": f"cast(power(2D, greatest(0D, ceil(log2({num(sr)} / {width})))) as long)", "octave": f"cast(floor({k} / {per}) as int)"}
    return {name: F.expr(x) for name, x in sql.items()}


def resolution_table(spark: SparkSession, f_min: float, n_bins: int, sr: float, bins_per_octave: int = 12, kind: str = "cq", gamma: float = 0.0) -> DataFrame:
    """(k, hz, bandwidth, q, n_fft, octave) of every bin."""
    return spark.range(n_bins).select(F.col("id").cast("int").alias("k"), *(c.alias(n) for n, c in resolution("id", f_min, sr, bins_per_octave, kind, gamma).items()))


def chunks(samples: DataFrame, length: int, overlap: float = 0.5) -> DataFrame:
    """(clip_id, chunk, n, x): samples in overlapping chunks, so that a long clip is many tasks' work."""
    step = max(1, int(length * (1 - overlap)))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (length - 1)) / step).cast("long"))
    return samples.select("clip_id", F.explode(F.sequence(first, F.floor(F.col("n") / step).cast("long"))).alias("chunk"), "n", "x")


def cross_fade(parts: DataFrame, length: int, overlap: float = 0.5) -> DataFrame:
    """(clip_id, n, x) from (clip_id, chunk, n, x): overlapping chunks faded over half a period, over the sum of weights."""
    step = max(1, int(length * (1 - overlap)))
    fade = max(1, length - step)
    at = F.col("n") - F.col("chunk") * step
    edge = F.least(at + 0.5, length - at - 0.5) / fade
    w = F.pow(F.sin(F.least(F.lit(1.0), edge) * (math.pi / 2)), F.lit(2.0))
    return parts.withColumn("w_", w).groupBy("clip_id", "n").agg((F.sum(F.col("x") * F.col("w_")) / F.sum("w_")).alias("x"))


def separate_by_masks(spectra: DataFrame, masks: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(clip_id, source, n, x): signals of each source's complex mask (clip_id, source, t, mre, mim) on a mixture's spectra.

    Masks come from any model; a source is a query's name.
    """
    joined = spectra.join(masks, ["clip_id", "t"])
    kept = spectral.complex_multiply(joined, ("re", "im"), ("mre", "mim"), ("r2", "i2"))
    return spectral.istft(kept.select("clip_id", "source", "t", F.col("r2").alias("re"), F.col("i2").alias("im")), n_fft, hop, keys=("clip_id", "source"))


def inverse_cqt_magnitude(magnitudes: DataFrame, sr: float, hop: int, f_min: float, n_bins: int, bins_per_octave: int = 12, rounds: int = 32, seed: int = 1, angle: str | None = None) -> DataFrame:
    """(clip_id, n, x) from magnitudes alone: phases start as hashes, or as ``angle`` says, and are those of the signal so far in each round.

    Blocks and first phases as in ``griffin_lim``.
    """
    wave = sinusoids(sr, hop, f_min, n_bins, bins_per_octave)
    bank = spectral.cqt_kernels(sr, f_min, n_bins, bins_per_octave)
    project = blocks.Projection(hop, blocks.hann(4 * hop), lambda c: 2 * (c.real @ wave.real - c.imag @ wave.imag), lambda v: v @ bank, len(bank))
    spectra = blocks.rebuilt(blocks.polar_start(magnitudes, angle or blocks.hashed_phase(seed)), project, rounds, 0.0, best_of=False)
    return inverse_cqt(spectra, sr, hop, f_min, n_bins, bins_per_octave)
