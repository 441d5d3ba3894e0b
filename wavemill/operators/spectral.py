"""Short-time spectra, filterbanks, cepstra and their inverses.

Frames are rows, so every transform of a frame is one small matrix step in an Arrow batch or one expression. Rows that
belong together (a clip's loudest value, overlapping frames) meet by grouping on the clip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.arrays import let
from wavemill.operators import scan
from wavemill.operators.blocks import Projection, hashed_phase, matrix, overlap_add_blocks, polar_start, rebuilt, rows_of, samples_of, typed
from wavemill.operators.frames import frame


#: Values of frames that a step transforms at a time.
FRAME_VALUES = 1 << 20


def map_frames(rows: DataFrame, column: str, outputs: list[str], step: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """Replace a column of equal-length arrays by others, a batch of rows at a time. ``step`` maps a matrix to matrices."""
    others = [c for c in rows.columns if c != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column] + [f"`{o}` array<double>" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [rows_of(m) for m in step(matrix(batch.column(batch.schema.get_field_index(column))))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), *made], names=[*others, *outputs])

    return rows.mapInArrow(run, schema)


def padded(y: np.ndarray, pad: int, mode: str) -> np.ndarray:
    """y with ``pad`` samples on both sides; reflect wraps round where y is shorter than that, and empty stays empty."""
    if not pad or not len(y):
        return y
    if mode == "reflect":
        return np.concatenate([y[np.arange(pad, 0, -1) % len(y)], y, y[len(y) - 1 - np.arange(1, pad + 1) % len(y)]])
    if mode not in ("constant", "edge"):
        raise ValueError(f"no padding {mode!r}")
    return np.pad(y, pad, mode=mode)


def from_frames(
    clips: DataFrame, outputs: list[str], finish: Callable[[np.ndarray], tuple[np.ndarray, ...]], n_fft: int, hop: int, window: str = "hann", win_length: int | None = None, center: bool = True, pad_mode: str = "constant"
) -> DataFrame:
    """(clip_id, t, outputs): what ``finish`` makes of the spectra (frames, bins) of windowed frames; centred frames by padding half a frame at both ends.

    Arrays (clip_id, y) are cut, windowed and transformed in one step that gives some frames at a time; tall samples are framed by blocks.
    """
    w = np.zeros(n_fft)
    w[: win_length or n_fft] = window_values(window, win_length or n_fft)
    pad, names = n_fft // 2 if center else 0, ["clip_id", "t", *outputs]
    if "y" not in clips.columns:
        return map_frames(frame(clips, n_fft, hop, pad, pad_mode), "v", outputs, lambda v: finish(np.fft.rfft(v * w, axis=1)))
    some = max(1, FRAME_VALUES // n_fft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clip, held, at, count = batch.column(0), [], [], 0
            for k, y in enumerate(batch.column(1)):
                x = padded(np.asarray(y.values), pad, pad_mode) if y.is_valid else np.zeros(0)
                if len(x) < n_fft:
                    continue
                frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
                for first in range(0, len(frames), some):
                    part = frames[first : first + some]
                    held.append(part)
                    at.append((k, first, len(part)))
                    count += len(part)
                    if count >= some:
                        yield give(clip, held, at)
                        held, at, count = [], [], 0
            if held:
                yield give(clip, held, at)

    def give(clip: pa.Array, held: list[np.ndarray], at: list[tuple[int, int, int]]) -> pa.RecordBatch:
        made = finish(np.fft.rfft(np.concatenate(held) * w, axis=1))
        rows = np.concatenate([np.full(n, k) for k, _, n in at])
        t = np.concatenate([np.arange(first, first + n) for _, first, n in at]).astype(np.int32)
        return pa.RecordBatch.from_arrays([clip.take(pa.array(rows)), pa.array(t), *map(rows_of, made)], names=names)

    schema = f"{typed(clips, ['clip_id'])}, t int, " + ", ".join(f"`{o}` array<double>" for o in outputs)
    return clips.select("clip_id", F.col("y").cast("array<double>")).mapInArrow(run, schema)


def stft(clips: DataFrame, n_fft: int = 2048, hop: int = 512, window: str = "hann", win_length: int | None = None, center: bool = True, pad_mode: str = "constant") -> DataFrame:
    """(clip_id, t, re, im) of windowed frames, see ``from_frames``."""
    return from_frames(clips, ["re", "im"], lambda s: (s.real, s.imag), n_fft, hop, window, win_length, center, pad_mode)


def power_frames(clips: DataFrame, n_fft: int = 2048, hop: int = 512, weights: np.ndarray | None = None, **more) -> DataFrame:
    """(clip_id, t, v): squared magnitudes of the spectra, through filters if given, in the same step."""
    bank = None if weights is None else np.ascontiguousarray(weights.T)

    def finish(s: np.ndarray) -> tuple[np.ndarray, ...]:
        p = s.real * s.real + s.imag * s.imag
        return (p if bank is None else p @ bank,)

    return from_frames(clips, ["v"], finish, n_fft, hop, **more)


def magnitude_frames(clips: DataFrame, n_fft: int = 2048, hop: int = 512, **more) -> DataFrame:
    """(clip_id, t, v): magnitudes of the spectra in the same step."""
    return from_frames(clips, ["v"], lambda s: (np.abs(s),), n_fft, hop, **more)


def power(spectra: DataFrame) -> DataFrame:
    return spectra.select("clip_id", "t", F.expr("zip_with(re, im, (a, b) -> a * a + b * b)").alias("v"))


def magnitude(spectra: DataFrame) -> DataFrame:
    return spectra.select("clip_id", "t", F.expr("zip_with(re, im, (a, b) -> sqrt(a * a + b * b))").alias("v"))


def phase(spectra: DataFrame) -> DataFrame:
    return spectra.select("clip_id", "t", F.expr("zip_with(re, im, (a, b) -> atan2(b, a))").alias("v"))


def from_polar(rows: DataFrame, mag: str = "mag", angle: str = "angle") -> DataFrame:
    return rows.withColumns({"re": F.expr(f"zip_with({mag}, {angle}, (m, p) -> m * cos(p))"), "im": F.expr(f"zip_with({mag}, {angle}, (m, p) -> m * sin(p))")})


def complex_multiply(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], out: tuple[str, str] = ("re", "im")) -> DataFrame:
    """Element-wise product of two complex columns; also applies a complex mask."""
    re = f"transform({a[0]}, (x, i) -> x * {b[0]}[i] - {a[1]}[i] * {b[1]}[i])"
    im = f"transform({a[0]}, (x, i) -> x * {b[1]}[i] + {a[1]}[i] * {b[0]}[i])"
    return rows.withColumns({out[0]: F.expr(re), out[1]: F.expr(im)})


def istft(spectra: DataFrame, n_fft: int = 2048, hop: int = 512, window: str = "hann", center: bool = True, length: int | None = None, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """(keys, n, x): windowed inverse frames summed where they overlap, over the sum of squared windows."""
    return samples_of(istft_blocks(spectra, n_fft, hop, window, center, length, keys), keys)


def istft_blocks(spectra: DataFrame, n_fft: int = 2048, hop: int = 512, window: str = "hann", center: bool = True, length: int | None = None, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """The same as stretches of samples (keys, n, y)."""
    frames = map_frames(spectra.select(*keys, "t", F.concat("re", "im").alias("c_")), "c_", ["v"], lambda c: (np.fft.irfft(c[:, : c.shape[1] // 2] + 1j * c[:, c.shape[1] // 2 :], n=n_fft, axis=1),))
    return overlap_add_blocks(frames, n_fft, hop, np.asarray(window_values(window, n_fft)), n_fft // 2 if center else 0, length, keys)


def overlap_add(frames: DataFrame, n_fft: int, hop: int, window: str = "hann", trim: int = 0, length: int | None = None) -> DataFrame:
    """(clip_id, n, x) of frames times a window, summed by blocks of frames, so that a long clip is many tasks' work."""
    return samples_of(overlap_add_blocks(frames, n_fft, hop, np.asarray(window_values(window, n_fft)), trim, length))


def window_values(kind: str, length: int) -> list[float]:
    """A periodic window."""
    if length == 1:
        return [1.0]
    k = [2 * math.pi * i / length for i in range(length)]
    return {
        "hann": [0.5 - 0.5 * math.cos(a) for a in k], "hamming": [0.54 - 0.46 * math.cos(a) for a in k], "blackman": [max(0.0, 0.42 - 0.5 * math.cos(a) + 0.08 * math.cos(2 * a)) for a in k],
        "bartlett": [1 - abs((i - length / 2) / (length / 2)) for i in range(length)], "rectangular": [1.0] * length,
    }[kind]


def _mel(f: float, style: str) -> float:
    if style == "htk":
        return 2595 * math.log10(1 + f / 700)
    if style == "kaldi":
        return 1127 * math.log(1 + f / 700)
    return f / (200 / 3) if f < 1000 else 15 + math.log(f / 1000) / (math.log(6.4) / 27)


def _hz(m: float, style: str) -> float:
    if style == "htk":
        return 700 * (10 ** (m / 2595) - 1)
    if style == "kaldi":
        return 700 * (math.exp(m / 1127) - 1)
    return m * 200 / 3 if m < 15 else 1000 * math.exp((math.log(6.4) / 27) * (m - 15))


def mel_weights(n_mels: int, n_fft: int, sr: float, f_min: float = 0.0, f_max: float | None = None, style: str = "slaney") -> np.ndarray:
    """Triangles (n_mels, n_fft / 2 + 1): slaney (unit area), htk (unit peak) or kaldi (slopes in mel, no last bin)."""
    f_max = f_max or sr / 2
    lo, hi = _mel(f_min, style), _mel(f_max, style)
    mels = [lo + (hi - lo) * i / (n_mels + 1) for i in range(n_mels + 2)]
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    if style == "kaldi":
        x, e = np.array([_mel(f, style) for f in bins]), np.array(mels)
    else:
        x, e = bins, np.array([_hz(m, style) for m in mels])
    up = (x[None, :] - e[:-2, None]) / (e[1:-1] - e[:-2])[:, None]
    down = (e[2:, None] - x[None, :]) / (e[2:] - e[1:-1])[:, None]
    w = np.maximum(0, np.minimum(up, down))
    if style == "kaldi":
        w[:, -1] = 0
    if style == "slaney":
        w *= (2 / (e[2:] - e[:-2]))[:, None]
    return w


def filterbank(spark, weights: np.ndarray) -> DataFrame:
    """(m, k, w): the weights above zero as a table, for joins."""
    m, k = np.nonzero(weights)
    return spark.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(m, k, strict=True)], "m int, k int, w double")


def apply_filterbank(frames: DataFrame, weights: np.ndarray) -> DataFrame:
    """v of each frame through the filters."""
    w = np.ascontiguousarray(weights.T)
    return map_frames(frames, "v", ["v"], lambda v: (v @ w,))


def apply_filterbank_join(frames: DataFrame, weights: np.ndarray) -> DataFrame:
    """The same by joining bins with the table of weights, (clip_id, t, m, value): for sparse or very wide spectra."""
    bins = frames.select("clip_id", "t", F.posexplode("v").alias("k", "p"))
    # The table has as many rows as the filters have weights: fixed by the parameters, not by the data.
    return bins.join(F.broadcast(filterbank(frames.sparkSession, weights)), "k").groupBy("clip_id", "t", "m").agg(F.sum(F.col("p") * F.col("w")).alias("value"))


def mel_spectrogram(clips: DataFrame, sr: float = 22050, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, style: str = "slaney", **more) -> DataFrame:
    return power_frames(clips, n_fft, hop, mel_weights(n_mels, n_fft, sr, style=style), **more)


def top_db(frames: DataFrame, floor: float | None = 80.0, ref: float = 1.0, amin: float = 1e-10) -> DataFrame:
    """10 log10 of v, not more than ``floor`` below the loudest value of the clip."""
    shift = 10 * math.log10(max(ref, amin))
    db = frames.withColumn("v", F.expr(f"transform(v, x -> 10 * log10(greatest(x, {amin!r}D)) - {shift!r}D)"))
    if floor is None:
        return db
    loudest = db.groupBy(F.col("clip_id").alias("c_")).agg(F.max(F.array_max("v")).alias("peak_"))
    return db.join(loudest, F.col("clip_id") == F.col("c_")).withColumn("v", F.expr(f"transform(v, x -> greatest(x, peak_ - {floor!r}D))")).drop("c_", "peak_")


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, n = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    m = np.cos(np.pi * k * (2 * n + 1) / (2 * n_in)) * math.sqrt(2 / n_in)
    m[0] /= math.sqrt(2)
    return m


def cepstrum(log_mel: DataFrame, n_mfcc: int = 20, n_mels: int = 128, lifter: int = 0) -> DataFrame:
    m = dct_matrix(n_mfcc, n_mels)
    if lifter:
        m = m * (1 + lifter / 2 * np.sin(np.pi * np.arange(1, n_mfcc + 1) / lifter))[:, None]
    return apply_filterbank(log_mel, m)


def mfcc(clips: DataFrame, sr: float = 22050, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, n_mfcc: int = 20, lifter: int = 0, floor: float | None = 80.0) -> DataFrame:
    return cepstrum(top_db(mel_spectrogram(clips, sr, n_fft, hop, n_mels), floor), n_mfcc, n_mels, lifter)


def griffin_lim(magnitudes: DataFrame, n_fft: int, hop: int, iterations: int = 32, momentum: float = 0.99, window: str = "hann", seed: int = 1, angle: str | None = None) -> DataFrame:
    """(clip_id, n, x): signals whose spectra come near the magnitudes, with the phases of the round of the smallest error.

    The first phases are a hash of clip, frame and bin, so reruns agree, or ``angle``, SQL of clip_id, t and the bin i. Clips are cut
    into blocks of frames that make several rounds before they meet again.
    """
    w = np.asarray(window_values(window, n_fft))
    project = Projection(hop, w, lambda c: np.fft.irfft(c, n=n_fft, axis=2), lambda v: np.fft.rfft(v * w, axis=2), n_fft)
    spectra = rebuilt(polar_start(magnitudes, angle or hashed_phase(seed)), project, iterations, momentum)
    return istft(spectra, n_fft, hop, window)


def vocode(spectra: DataFrame, rate: float, n_fft: int, hop: int) -> DataFrame:
    """Frames at ``rate`` times the speed: magnitudes interpolated, phase advances summed along the clip.

    Frames of zero and more are made of the two next to their place, found by joins on it.
    """
    turn = f"2 * pi() * {hop} / {n_fft}"
    frames = spectra.select("clip_id", "t", F.expr("zip_with(re, im, (a, b) -> sqrt(a * a + b * b))").alias("m"), F.expr("zip_with(re, im, (a, b) -> atan2(b, a))").alias("p"))
    last = frames.groupBy(F.col("clip_id").alias("c_")).agg(F.max("t").alias("last_"))
    outs = last.select("c_", "last_", F.explode(F.expr(f"sequence(0, greatest(0, cast(round((last_ + 1) / {rate!r}D) as int) - 1))")).alias("u"))
    outs = outs.withColumns({"pos": F.expr(f"u * {rate!r}D"), "lo": F.expr(f"least(last_, cast(floor(u * {rate!r}D) as int))")})
    a, b = (frames.select(F.col("clip_id").alias(f"c{k}"), F.col("t").alias(f"t{k}"), F.col("m").alias(f"m{k}"), F.col("p").alias(f"p{k}")) for k in (1, 2))
    both = outs.join(a, (F.col("c_") == F.col("c1")) & (F.col("lo") == F.col("t1"))).join(b, (F.col("c_") == F.col("c2")) & (F.least(F.col("lo") + 1, F.col("last_")) == F.col("t2")))
    step = f"transform(p1, (x, k) -> {let(f'p2[k] - x - k * {turn}', 'd', f'k * {turn} + d - 2 * pi() * round(d / (2 * pi()))')})"
    made = both.select(F.col("c_").alias("clip_id"), F.col("u").alias("t"), F.expr("zip_with(m1, m2, (x, y) -> x + (pos - lo) * (y - x))").alias("mag"), "p1", F.expr(step).alias("step"))
    # The phase is that of the first frame and all advances since: a running sum over blocks of frames.
    blocks = scan.blocks_of(made, ["clip_id"], "t", "step", 512)
    first = made.where("t = 0").select("clip_id", F.col("p1").alias("s"))
    summed = scan.recurrence(blocks, ["clip_id"], 1.0, initial=first, before=True)
    width = "cast(size(s) / size(t) as int)"
    turned = summed.select("clip_id", F.posexplode("t").alias("i_", "t"), F.col("s"), F.expr(width).alias("w_")).select("clip_id", F.col("t").cast("int").alias("t"), F.expr("slice(s, i_ * w_ + 1, w_)").alias("angle"))
    return from_polar(made.select("clip_id", "t", "mag").join(turned, ["clip_id", "t"])).select("clip_id", "t", "re", "im")


def time_stretch(clips: DataFrame, rate: float, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """(clip_id, n, x) of clips played at ``rate`` times the speed at the same pitch."""
    return istft(vocode(stft(clips, n_fft, hop), rate, n_fft, hop), n_fft, hop)


def kernels(freqs: np.ndarray, sr: float, length: int, q: float, gamma: float = 0.0) -> np.ndarray:
    """Windowed complex exponentials, one a frequency, centred in ``length`` samples, of unit absolute sum."""
    out = np.zeros((len(freqs), length), dtype=complex)
    for k, f in enumerate(freqs):
        n = int(min(length, max(2, math.ceil(sr / (f / q + gamma)))))
        at = (length - n) // 2
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        out[k, at : at + n] = w / w.sum() * np.exp(-2j * np.pi * f * np.arange(-(n // 2), n - n // 2) / sr)
    return out


def cqt_kernels(sr: float, f_min: float, n_bins: int, bins_per_octave: int = 12, gamma: float = 0.0, length: int | None = None) -> np.ndarray:
    """The transform's matrix (samples, bins)."""
    freqs = f_min * 2.0 ** (np.arange(n_bins) / bins_per_octave)
    q = 1 / (2 ** (1 / bins_per_octave) - 1)
    return kernels(freqs, sr, length or int(math.ceil(sr / (freqs[0] / q + gamma))), q, gamma).T.copy()


def cqt(clips: DataFrame, sr: float, hop: int, f_min: float, n_bins: int, bins_per_octave: int = 12, gamma: float = 0.0, length: int | None = None) -> DataFrame:
    """(clip_id, t, re, im): constant-Q transform by correlation with kernels; with ``gamma`` a variable Q.

    Frames are centred on multiples of ``hop``; ``length`` (default: the longest kernel) is the frame's.
    """
    bank = cqt_kernels(sr, f_min, n_bins, bins_per_octave, gamma, length)
    frames = frame(clips, len(bank), hop, len(bank) // 2)

    def step(v: np.ndarray) -> tuple[np.ndarray, ...]:
        c = v @ bank
        return c.real, c.imag

    return map_frames(frames, "v", ["re", "im"], step)


def pseudo_cqt(clips: DataFrame, sr: float, n_fft: int, hop: int, f_min: float, n_bins: int, bins_per_octave: int = 12) -> DataFrame:
    """Magnitudes of spectrum bins through triangles around constant-Q frequencies."""
    freqs = f_min * 2.0 ** (np.arange(n_bins) / bins_per_octave)
    width = freqs * (2 ** (1 / bins_per_octave) - 1)
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    w = np.maximum(0, 1 - np.abs(bins[None, :] - freqs[:, None]) / np.maximum(width, sr / n_fft)[:, None])
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-10)
    return apply_filterbank(magnitude_frames(clips, n_fft, hop), w)


def chroma_weights(n_fft: int, sr: float) -> np.ndarray:
    """Bins to the twelve pitch classes, C first; bins below 20 Hz to none."""
    w = np.zeros((12, n_fft // 2 + 1))
    for k in range(1, n_fft // 2 + 1):
        f = k * sr / n_fft
        if f >= 20:
            w[int(math.trunc(math.floor(69 + 12 * math.log2(f / 440) + 0.5))) % 12, k] = 1
    return w


def chroma(clips: DataFrame, sr: float = 22050, n_fft: int = 4096, hop: int = 512, norm: str | None = "l2") -> DataFrame:
    folded = power_frames(clips, n_fft, hop, chroma_weights(n_fft, sr))
    size = {"l1": "aggregate(v, 0D, (s, x) -> s + abs(x))", "l2": "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))", "max": "array_max(transform(v, x -> abs(x)))", None: "1D"}[norm]
    return folded.withColumn("v", F.expr(let(size, "n", "case when n > 1e-10 then transform(v, x -> x / n) else v end")))


def chroma_from_cqt(frames: DataFrame, f_min: float, bins_per_octave: int, n_bins: int) -> DataFrame:
    """Constant-Q magnitudes folded to twelve classes, neighbours of a class's centre merged."""
    merge = bins_per_octave // 12
    base = int(round(69 + 12 * math.log2(f_min / 440)))
    w = np.zeros((12, n_bins))
    for k in range(n_bins):
        w[(base + ((k + merge // 2) // merge)) % 12, k] = 1
    return apply_filterbank(frames, w)


def tonnetz(chroma_frames: DataFrame) -> DataFrame:
    """Six coordinates of fifths, minor and major thirds from chroma of unit sum."""
    c = np.arange(12)
    turns, radii = (7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3), (1, 1, 1, 1, 0.5, 0.5)
    w = np.stack([r * (np.sin if k % 2 == 0 else np.cos)(np.pi * c * a) for k, (a, r) in enumerate(zip(turns, radii, strict=True))])
    unit = chroma_frames.withColumn("v", F.expr(let("aggregate(v, 0D, (s, x) -> s + abs(x))", "n", "case when n > 1e-10 then transform(v, x -> x / n) else v end")))
    return apply_filterbank(unit, w)


def cens(chroma_frames: DataFrame, smooth: int = 41) -> DataFrame:
    """Chroma energy statistics: unit sum, four steps, smoothed along the clip, unit length."""
    unit = let("aggregate(v, 0D, (s, x) -> s + abs(x))", "n", "transform(v, x -> case when n > 1e-10 then x / n else 0D end)")
    quant = F.expr(f"transform({unit}, x -> (case when x > 0.4 then 1D else 0D end + case when x > 0.2 then 1D else 0D end + case when x > 0.1 then 1D else 0D end + case when x > 0.05 then 1D else 0D end) / 4)")
    bins = chroma_frames.select("clip_id", "t", F.posexplode(quant).alias("k", "x"))
    half = smooth // 2
    offsets = bins.select("clip_id", "k", "x", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("d"), "t")
    w = 0.5 - 0.5 * F.cos(2 * math.pi * (F.col("d") + half + 1) / (smooth + 1))
    ends = chroma_frames.groupBy(F.col("clip_id").alias("c_")).agg(F.max("t").alias("last_"))
    near = offsets.join(ends, F.col("clip_id") == F.col("c_")).withColumn("t", F.col("t") + F.col("d")).where("t between 0 and last_")
    smoothed = near.groupBy("clip_id", "t", "k").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x")).groupBy("clip_id", "t").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    return smoothed.select("clip_id", "t", F.expr(let("transform(s, z -> z.x)", "v", let("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))", "n", "transform(v, x -> case when n > 1e-10 then x / n else 0D end)"))).alias("v"))
