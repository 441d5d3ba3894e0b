"""Seeded augmentation and test signals. Random numbers are hashes of row, place and seed: reruns agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.arrays import bound, leaky, let, squares
from wavemill.operators.blocks import lists_of

#: Samples that the metronome makes at a time in a task.
SOME = 1 << 18


def num(x: float | str) -> str:
    """SQL of a parameter: a number, or SQL of a row's columns as it is."""
    return f"({x})" if isinstance(x, str) else f"{float(x)!r}D"


def uniform(*of: str, seed: int = 1) -> str:
    """SQL of a number in [0, 1)."""
    return f"(shiftrightunsigned(xxhash64({', '.join(of)}, {seed}), 11) / 9007199254740992D)"


def normal(*of: str, seed: int = 1) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(*of, seed=seed)})) * cos(2 * pi() * {uniform(*of, seed=seed + 1)}))"


def add_noise(y: str, key: str, snr_db: float, seed: int = 1, noise: str | None = None) -> Column:
    """White noise at a signal-to-noise ratio; ``noise``, SQL of an array as long as y, takes its place."""
    def body(y: str) -> str:
        made = noise or f"transform({y}, (x, i) -> {normal(key, 'i', seed=seed)})"
        return let(made, "n", let(f"sqrt({squares(y)} / {10 ** (snr_db / 10)!r}D / greatest({squares('n')}, 1e-10D))", "g", f"transform({y}, (x, i) -> x + g * n[i])"))

    return F.expr(bound(y, body))


def random_gain(y: str, key: str, low_db: float, high_db: float, seed: int = 1) -> Column:
    return F.expr(let(f"power(10D, ({low_db!r}D + {uniform(key, seed=seed)} * {high_db - low_db!r}D) / 20)", "g", f"transform({y}, x -> x * g)"))


def mask_bands(values: DataFrame, f_width: int, t_width: int, f_masks: int = 1, t_masks: int = 1, seed: int = 1, fill: float | None = None, draw: Callable[[str, int, int], str] | None = None) -> DataFrame:
    """Tall values with random bands of features and frames replaced by ``fill``, the clip's mean if None.

    A band's width and start are drawn from clip, kind and number; ``draw`` gives other SQL of a number in [0, 1) for (kind, number, 0 or 1).
    """
    size = values.groupBy(F.col("clip_id").alias("c_")).agg((F.max("f") + 1).alias("nf"), (F.max("t") + 1).alias("nt"), F.avg("x").alias("mean_"))
    draw = draw or (lambda kind, k, which: uniform("clip_id", repr(kind), str(k), seed=seed + which))
    hit = F.lit(False)
    for kind, n, width, masks in (("f", "nf", f_width, f_masks), ("t", "nt", t_width, t_masks)):
        for k in range(masks):
            w = f"cast({draw(kind, k, 0)} * ({width} + 1) as int)"
            start = f"cast({draw(kind, k, 1)} * greatest(1, {n} - {w} + 1) as int)"
            hit = hit | F.expr(f"{kind} >= {start} and {kind} < {start} + {w}")
    joined = values.join(size, F.col("clip_id") == F.col("c_"))
    return joined.withColumn("x", F.when(hit, F.col("mean_") if fill is None else F.lit(fill)).otherwise(F.col("x"))).select("clip_id", "t", "f", "x")


def signals(rows: DataFrame, clip_id: str, sql: str, n: int | str) -> DataFrame:
    """(clip_id, y): a generated signal of every row, ``sql`` an expression of the sample number i and the row's columns."""
    return rows.select(F.col(clip_id).cast("long").alias("clip_id"), F.expr(f"case when {n} < 1 then cast(array() as array<double>) else transform(sequence(0, greatest(0, cast({n} as int) - 1)), i -> cast({sql} as double)) end").alias("y"))


def signal(spark: SparkSession, sql: str, n: int, clip_id: int = 0) -> DataFrame:
    """(clip_id, y) of one generated signal, ``sql`` an expression of the sample number i."""
    return signals(spark.range(clip_id, clip_id + 1), "id", sql, n)


def tone(freq: float | str, sr: float | str, amplitude: float | str = 1.0, phase: float | str = 0.0) -> str:
    """Parameters of this and the next ones are numbers or SQL of a row's columns."""
    return f"{num(amplitude)} * sin(2 * pi() * {num(freq)} * i / {num(sr)} + {num(phase)})"


def tones(freqs: list[float | str], sr: float | str, amplitudes: list[float | str] | None = None) -> str:
    return " + ".join(tone(f, sr, a) for f, a in zip(freqs, amplitudes or [1 / len(freqs)] * len(freqs), strict=True))


def chirp(low: float | str, high: float | str, sr: float | str, n: float | str, kind: str = "exponential") -> str:
    """Sweep over n samples: linear, exponential, quadratic or hyperbolic."""
    a, b, d, t = num(low), num(high), f"({num(n)} / {num(sr)})", f"(i / {num(sr)})"
    cycles = {
        "linear": f"({a} * {t} + ({b} - {a}) / (2 * {d}) * {t} * {t})",
        "exponential": f"(case when {a} = {b} then {a} * {t} else {a} * {d} / ln({b} / {a}) * (power({b} / {a}, {t} / {d}) - 1) end)",
        "quadratic": f"({a} * {t} + ({b} - {a}) / (3 * {d} * {d}) * power({t}, 3))",
        "hyperbolic": f"(case when {a} = {b} then {a} * {t} else -{a} * {b} * {d} / ({b} - {a}) * ln(1 - ({b} - {a}) / ({b} * {d}) * {t}) end)",
    }[kind]
    return f"sin(2 * pi() * {cycles})"


def clicks(at: list[int], n_click: int, freq: float, sr: float, gain: float = 1.0) -> str:
    """Decaying sines at sample numbers, summed and cut off at one."""
    one = "case when i >= {a} and i < {b} then {g}D * (1 - (i - {a}) / {l}D) * sin(2 * pi() * {f}D * (i - {a}) / {s}D) else 0D end"
    total = " + ".join(one.format(a=a, b=a + n_click, g=gain, l=n_click, f=freq, s=sr) for a in at) or "0D"
    return f"greatest(-1D, least(1D, {total}))"


def white(seed: int = 1) -> str:
    return f"2 * {uniform('i', seed=seed)} - 1"


def brown(y: str) -> Column:
    """Brown noise from white: a leaky running sum."""
    return F.transform(leaky(y, 1 / 1.02, 0.02 / 1.02), lambda x: 3.5 * x)


def pink(y: str) -> Column:
    """Pink noise from white: seven leaky sums. Their poles and gains."""
    poles = [(0.99886, 0.0555179), (0.99332, 0.0750759), (0.969, 0.153852), (0.8665, 0.3104856), (0.55, 0.5329522), (-0.7616, -0.016898)]
    parts = F.arrays_zip(F.col(y).alias("x"), *(leaky(y, p, g).alias(f"b{k}") for k, (p, g) in enumerate(poles)))
    before = lambda i: F.when(i > 0, F.col(y)[i - 1]).otherwise(0.0)
    return F.transform(parts, lambda z, i: 0.11 * (sum((z[f"b{k}"] for k in range(len(poles))), F.lit(0.0)) + 0.115926 * before(i) + 0.5362 * z["x"]))


def _beats(bpm: np.ndarray, sr: np.ndarray, freq: np.ndarray, sizes: np.ndarray, per_bar: int, click: float, most: int | None) -> np.ndarray:
    """The metronomes of some rows end to end: clicks are added at their beats, some clicks at a time."""
    y, starts = np.zeros(int(sizes.sum())), np.cumsum(sizes) - sizes
    with np.errstate(all="ignore"):
        length = np.floor(click * sr)
        # A beat sounds in the row if its place is before the row's end and less than a click before its start; time runs back at a tempo below zero.
        beats = np.floor(np.where(bpm > 0, sizes, length) * np.abs(bpm) / (60 * sr)) + 2
    beats = np.where(np.isfinite(beats) & np.isfinite(freq) & (bpm != 0) & (length >= 1), beats, 0.0)
    lasts = np.cumsum((beats if most is None else np.minimum(beats, most)).astype(np.int64))
    total, longest = int(lasts[-1]), int(length[beats > 0].max(initial=1))
    step = max(1, SOME // longest)
    for first in range(0, total, step):
        k = np.arange(first, min(first + step, total))
        row = np.searchsorted(lasts, k, side="right")
        b = k - np.where(row > 0, lasts[row - 1], 0)
        place = np.floor(b * 60 / bpm[row] * sr[row])
        near = (place < sizes[row]) & (place > -length[row])
        row, bar, place = row[near, None], b[near, None] % per_bar == 0, place[near, None]
        j = np.arange(longest)
        x = np.where(bar, 1.0, 0.7) * (1 - j / length[row]) * np.sin(2 * np.pi * freq[row] * np.where(bar, 2, 1) * j / sr[row])
        heard = (j < length[row]) & (place + j >= 0) & (place + j < sizes[row])
        np.add.at(y, (starts[row] + place.astype(np.int64) + j)[heard], x[heard])
    return y


def metronome(rows: DataFrame, clip_id: str, bpm: float | str, sr: float | str, n: int | str, freq: float | str = 1000.0, per_bar: int = 4, click: float = 0.05, beats: int | None = None) -> DataFrame:
    """(clip_id, y): n samples of clicks on every beat of a row's tempo, the first of a bar an octave higher and louder; not cut off at one.

    ``beats`` ends the clicks after so many of them. A row without a tempo, or of tempo 0, is silent. A few narrow rows make many samples, so rows are
    dealt to all tasks before, however few files they come from.
    """
    numbers = [F.expr(f"cast({num(x)} as double)").alias(name) for name, x in (("bpm", bpm), ("sr", sr), ("freq", freq))]
    known = rows.select(F.col(clip_id).cast("long").alias("clip_id"), *numbers, F.expr(f"greatest(0, coalesce(cast({n} as int), 0))").alias("n"))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpm, sr, freq = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            sizes = batch.column(4).to_numpy().astype(np.int64)
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SOME, side="right")))
                some = slice(first, last)
                y = _beats(bpm[some], sr[some], freq[some], sizes[some], per_bar, click, beats)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists_of(y, sizes[some])], names=["clip_id", "y"])
                first = last

    return known.repartition(tasks, "clip_id").mapInArrow(run, "clip_id long, y array<double>")


def click_track(y: str, beats: str, n_click: int, freq: float, sr: float, gain: float = 0.5) -> Column:
    """y with a click written over it at every beat (sample numbers)."""
    def body(y: str) -> str:
        last = f"array_max(filter({beats}, b -> b <= i))"
        return f"transform({y}, (x, i) -> {let(last, 'b', f'case when b is not null and i < b + {n_click} then {gain!r}D * (1 - (i - b) / {n_click}D) * sin(2 * pi() * {freq!r}D * (i - b) / {sr!r}D) else x end')})"

    return F.expr(bound(y, body))
