"""Operators along time: differences, context, smoothing, recurrences, tempo.

Values are tall, (clip_id, t, f, x), where a step looks at neighbours: a stretch of a track (clip_id, f) is the unit of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wavemill.functions.arrays import bound, let, total, upper_median
from wavemill.operators import scan
from wavemill.operators.blocks import over_frames, reaching, sliding_median, typed


#: Steps of a track that one task looks at; tracks are numbered from 0 without gaps.
STRETCH = 1 << 14


def stretches(values: DataFrame, before: int, after: int, per: int) -> tuple[DataFrame, WindowSpec, WindowSpec, Column]:
    """``values`` in stretches b_ with some rows of the track around them, windows over a stretch in and without order, and the track's length where its end is in sight."""
    per = max(per, before, after)
    rows = values.withColumn("b_", reaching("t", per, before, after))
    whole = Window.partitionBy("clip_id", "f", "b_")
    last = F.max("t").over(whole)
    return rows, whole.orderBy("t"), whole, F.when(last < (F.col("b_") + 1) * per + after - 1, last + 1)


def own(rows: DataFrame, per: int, before: int, after: int) -> DataFrame:
    """The rows of a stretch without those around it."""
    return rows.where(F.floor(F.col("t") / max(per, before, after)) == F.col("b_")).drop("b_")


def delta(values: DataFrame, width: int = 9, per: int = STRETCH) -> DataFrame:
    """dx: slope over ``width`` frames; inside half a width of an end the slope of the line through the end's frames.

    A track shorter than ``width`` has one line through all of it.
    """
    half = width // 2
    rows, track, whole, length = stretches(values, width, half + 1, per)
    inner = sum(((F.lead("x", n).over(track) - F.lag("x", n).over(track)) * n for n in range(1, half + 1)), F.lit(0.0)) / (2 * sum(n * n for n in range(1, half + 1)))
    placed = rows.withColumns({"n_": length, "d_": inner})
    at_head, at_tail = F.col("t") < width, F.col("t") >= F.col("n_") - width
    head = F.regr_slope(F.when(at_head, F.col("x")), F.when(at_head, F.col("t"))).over(whole)
    tail = F.regr_slope(F.when(at_tail, F.col("x")), F.when(at_tail, F.col("t"))).over(whole)
    placed = placed.withColumns({"h_": head, "e_": tail})
    dx = F.when(F.col("t") < half, F.col("h_")).when(F.col("t") >= F.col("n_") - half, F.col("e_")).otherwise(F.col("d_"))
    return own(placed.withColumn("dx", F.coalesce(dx, F.lit(0.0))).drop("n_", "d_", "h_", "e_"), per, width, half + 1)


def delta_clamped(values: DataFrame, width: int = 9, per: int = STRETCH) -> DataFrame:
    """dx with frames beyond an end taken as the end's."""
    half = width // 2
    rows, track, whole, _ = stretches(values, half, half, per)
    every = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("x").over(every), F.last("x").over(every)  # of the track where a neighbour is missing
    step = sum(((F.coalesce(F.lead("x", n).over(track), last) - F.coalesce(F.lag("x", n).over(track), first)) * n for n in range(1, half + 1)), F.lit(0.0))
    return own(rows.withColumn("dx", step / (2 * sum(n * n for n in range(1, half + 1)))), per, half, half)


def stack(values: DataFrame, steps: int = 2, delay: int = 1, mode: str = "constant", value: float = 0.0, ahead: int = 0, per: int = STRETCH) -> DataFrame:
    """s0, s1, ...: the value ``k * delay`` frames back (from ``ahead`` frames ahead on); ends constant or edge."""
    before, after = max(0, (steps - 1) * delay - ahead), max(0, ahead)
    rows, track, whole, _ = stretches(values, before, after, per)
    every = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for k in range(steps):
        at = k * delay - ahead
        moved = F.lag("x", at).over(track) if at >= 0 else F.lead("x", -at).over(track)
        edge = (F.first("x") if at >= 0 else F.last("x")).over(every)
        out[f"s{k}"] = F.coalesce(moved, edge if mode == "edge" else F.lit(value))
    return own(rows.withColumns(out), per, before, after)


def tracks(values: DataFrame, name: str = "y") -> DataFrame:
    """(clip_id, f, y): each feature's values over time as an array."""
    made = values.groupBy("clip_id", "f").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s_"))
    return made.select("clip_id", "f", F.expr("transform(s_, s -> s.x)").alias(name))


def pcen(values: DataFrame, b: float = 0.5927, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, eps: float = 1e-6, initial: DataFrame | None = None) -> DataFrame:
    """(clip_id, f, t, y, m): per-channel energy normalisation of tall values by a smoothed past m.

    The past starts from one, or from a track's row of ``initial`` (clip_id, f, s), an array of one number as ``pcen_state`` gives it.
    """
    return scan.unrolled(_smoothed(values, b, initial), ["clip_id", "f"], y=f"power({bias!r}D, {power!r}D) * expm1({power!r}D * ln(1 + v * exp(-{gain!r}D * (ln({eps!r}D) + ln(1 + s / {eps!r}D))) / {bias!r}D))", m="s")


def pcen_state(values: DataFrame, b: float = 0.5927, initial: DataFrame | None = None) -> DataFrame:
    """(clip_id, f, s): the past at the end of every track, from which a later part of it goes on."""
    return scan.final_states(_smoothed(values, b, initial), ["clip_id", "f"])


def _smoothed(values: DataFrame, b: float, initial: DataFrame | None) -> DataFrame:
    return scan.recurrence(scan.blocks_of(values, ["clip_id", "f"]), ["clip_id", "f"], 1 - b, b, 1.0, initial)


def preemphasis_tall(samples: DataFrame, c: float = 0.97, steps: int = scan.STEPS) -> DataFrame:
    """(clip_id, n, x): ``preemphasis`` of tall samples; a block gets the last sample before it."""
    blocks = scan.blocks_of(samples, ["clip_id"], "n", "x", steps)
    lasts = blocks.select("clip_id", (F.col("b") + 1).alias("b"), F.element_at("v", -1).alias("p_"))
    first = "x + (case when size(v) > 1 then 2 * x - v[1] else 0D end)"
    y = f"transform(v, (x, i) -> case when i > 0 then x - {c!r}D * v[i - 1] when p_ is null then {first} else x - {c!r}D * p_ end)"
    joined = blocks.join(lasts, ["clip_id", "b"], "left").withColumn("s", F.expr(y))
    return scan.unrolled(joined, ["clip_id"], x="s").withColumnRenamed("t", "n")


def deemphasis_tall(samples: DataFrame, c: float = 0.97, steps: int = scan.STEPS) -> DataFrame:
    """(clip_id, n, x): inverse of ``preemphasis_tall`` for signals of two samples and more, as a distributed recurrence."""
    blocks = scan.blocks_of(samples, ["clip_id"], "n", "x", steps)
    # The first sample without what was put before it, so that the recurrence starts from nothing.
    bare = f"case when b = 0 and size(v) > 1 then transform(v, (x, i) -> case when i = 0 then x - ({2 - c!r}D * x - v[1]) / {3 - c!r}D else x end) else v end"
    return scan.unrolled(scan.recurrence(blocks.withColumn("v", F.expr(bare)), ["clip_id"], c), ["clip_id"], x="s").withColumnRenamed("t", "n")


def preemphasis(y: str = "y", c: float = 0.97) -> Column:
    def body(y: str) -> str:
        return f"transform({y}, (x, i) -> case when i = 0 then x + (case when size({y}) > 1 then 2 * {y}[0] - {y}[1] else 0D end) else x - {c!r}D * {y}[i - 1] end)"

    return F.expr(bound(y, body))


def deemphasis(rows: DataFrame, y: str = "y", out: str = "y", c: float = 0.97) -> DataFrame:
    """``rows`` with ``out``, the inverse of ``preemphasis`` of the array ``y``, for signals of two samples and more.

    A step of its own and no expression: the optimizer would move one with a Python function in it to where it isn't run.
    """
    def one(y) -> np.ndarray | None:
        if y is None:
            return None
        x = np.array(y, dtype=float)
        if len(x) > 1:  # the first sample without what was put before it
            x[0] -= ((2 - c) * x[0] - x[1]) / (3 - c)
        return scan.running(x[:, None], c, np.zeros(1))[:, 0]

    kept = [n for n in rows.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(v.values) if v.is_valid else None for v in batch.column(batch.schema.get_field_index(y))]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.float64()))], names=[*kept, out])

    return rows.mapInArrow(run, ", ".join([*([typed(rows, kept)] if kept else []), f"`{out}` array<double>"]))


def median_filter(v: str, size: int) -> Column:
    """Upper median over a window cut off at the ends."""
    def body(v: str) -> str:
        half = size // 2
        window = f"slice({v}, greatest(1, i + 1 - {half}), least(size({v}), i + 1 + {half}) - greatest(1, i + 1 - {half}) + 1)"
        return f"transform({v}, (x, i) -> {upper_median(window)})"

    return F.expr(bound(v, body))


def median_filter_tall(samples: DataFrame, size: int) -> DataFrame:
    """(clip_id, n, x): ``median_filter`` of tall samples, by blocks with half a window around them."""
    half = size // 2

    def work(clip: pa.Array, t: np.ndarray, v: np.ndarray, mine: slice) -> pa.RecordBatch:
        m = sliding_median(np.swapaxes(v, 0, 1), half)[mine].swapaxes(0, 1)[:, :, 0]
        return pa.RecordBatch.from_arrays([clip.take(pa.array(np.repeat(np.arange(len(m)), m.shape[1]))), pa.array(t[:, mine].ravel()), pa.array(m.ravel())], names=["clip_id", "n", "x"])

    rows = samples.select("clip_id", F.col("n").alias("t"), F.array("x").alias("v"))
    return over_frames(rows, max(1 << 13, 16 * half), half, half, work, f"{typed(samples, ['clip_id'])}, n long, x double")


def rises_tall(samples: DataFrame, steps: int = scan.STEPS) -> DataFrame:
    """(clip_id, n, x): ``rises`` of tall samples; a block gets the last sample before it."""
    blocks = scan.blocks_of(samples, ["clip_id"], "n", "x", steps)
    lasts = blocks.select("clip_id", (F.col("b") + 1).alias("b"), F.element_at("v", -1).alias("p_"))
    y = "transform(v, (x, i) -> greatest(0D, x - case when i > 0 then v[i - 1] else coalesce(p_, x) end))"
    return scan.unrolled(blocks.join(lasts, ["clip_id", "b"], "left").withColumn("s", F.expr(y)), ["clip_id"], x="s").withColumnRenamed("t", "n")


def rises(v: str = "v") -> Column:
    def body(v: str) -> str:
        return f"transform({v}, (x, i) -> case when i = 0 then 0D else greatest(0D, x - {v}[i - 1]) end)"

    return F.expr(bound(v, body))


def intervals(v: str) -> Column:
    """First differences."""
    return F.expr(f"case when size({v}) < 2 then cast(array() as array<double>) else transform(sequence(1, size({v}) - 1), i -> cast({v}[i] - {v}[i - 1] as double)) end")


def autocorrelation(y: str, lags: int, unbiased: bool = False) -> Column:
    def body(y: str) -> str:
        over = f" / (size({y}) - l)" if unbiased else ""
        return f"transform(sequence(0, least({lags}, size({y})) - 1), l -> {total(f'transform(sequence(0, size({y}) - 1 - l), i -> {y}[i] * {y}[i + l])')}{over})"

    return F.expr(bound(y, body))


def tempogram(envelopes: DataFrame, win: int, hop: int = 1, fps: float = 43.07, bpm: tuple[float, float] = (30.0, 300.0), kind: str = "autocorrelation") -> DataFrame:
    """(clip_id, t, lag or k, bpm, value) of envelope frames: local autocorrelation, or twice the Fourier magnitude."""
    from wavemill.operators.frames import apply_window, frame

    frames = apply_window(frame(envelopes, win, hop), "hann", None, win)
    if kind == "autocorrelation":
        low, high = max(1, math.ceil(60 * fps / bpm[1])), min(win - 1, math.floor(60 * fps / bpm[0]))
        acf = F.expr(f"transform(sequence({low}, {high}), l -> {total(f'transform(sequence(0, {win - 1} - l), i -> v[i] * v[i + l])')} / ({win} - l))")
        return frames.select("clip_id", "t", F.posexplode(acf).alias("p", "value")).select("clip_id", "t", (F.col("p") + low).alias("lag"), (60 * fps / (F.col("p") + low)).alias("bpm"), "value")
    bins = [k for k in range(1, win // 2 + 1) if bpm[0] <= 60 * fps * k / win <= bpm[1]]
    wave = F.expr("transform(array(" + ", ".join(map(str, bins)) + f"), k -> 2 * sqrt(power({total(f'transform(v, (x, i) -> x * cos(2 * pi() * k * i / {win}))')}, 2) + power({total(f'transform(v, (x, i) -> x * sin(2 * pi() * k * i / {win}))')}, 2)))")
    at = F.element_at(F.array(*map(F.lit, bins)), F.col("p") + 1)
    return frames.select("clip_id", "t", F.posexplode(wave).alias("p", "value")).select("clip_id", "t", at.alias("k"), (60 * fps * at / win).alias("bpm"), "value")


def tempo(envelopes: DataFrame, fps: float, win: int = 384, start: float = 120.0, spread: float = 1.0, y: str = "y") -> DataFrame:
    """(clip_id, bpm): lag of the largest log autocorrelation with a log-normal prior; 0 for an even or empty envelope."""
    acf = F.expr(f"transform(sequence(0, least({win}, size({y})) - 1), l -> {total(f'transform(sequence(0, size({y}) - 1 - l), i -> {y}[i] * {y}[i + l])')})")
    rows = envelopes.where(F.size(y) > 1).withColumn("a_", acf).withColumn("n_", F.expr("transform(a_, x -> x / greatest(a_[0], 1e-10D))"))
    score = F.expr(f"transform(n_, (x, l) -> case when l = 0 then double('-Infinity') else ln(1 + 1e6D * greatest(x, 0D)) - 0.5D * power((log2(60 * {fps!r}D / l) - {math.log2(start)!r}D) / {spread!r}D, 2) end)")
    best = F.expr("cast(array_position(s_, array_max(s_)) - 1 as int)")
    found = rows.withColumn("s_", score).withColumn("l_", best)
    quiet = F.array_max(y) < 1e-10
    return found.select("clip_id", F.when(quiet | (F.col("l_") < 1) | (F.expr("n_[l_]") < 0.01), 0.0).otherwise(60 * fps / F.col("l_")).alias("bpm"))


def beats(envelopes: DataFrame, period: str, y: str = "y") -> Column:
    """Greedy walk: the strongest of two periods, then the strongest near each next period, or its place if all are weak."""
    def one(v: np.ndarray, p: int) -> list[int]:
        if p <= 0 or not len(v):
            return []
        near, limit, out = p // 4, 0.1 * v.max(), [int(v[: 2 * p].argmax())]
        while out[-1] + p < len(v):
            at = out[-1] + p
            w = v[max(0, at - near) : min(at + max(1, near), len(v))]
            out.append(max(0, at - near) + int(w.argmax()) if w.max() > limit else at)
        return out

    @F.pandas_udf("array<int>")
    def walk(ys: pd.Series, periods: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(v, dtype=float), int(p)) for v, p in zip(ys, periods, strict=True)])

    return walk(F.coalesce(F.col(y), F.expr("cast(array() as array<double>)")), F.coalesce(F.col(period), F.lit(0)))


def local_pulse(y: str, low: int, high: int) -> Column:
    """Predominant local pulse: each value raised by the best normalised autocorrelation around it, over the largest."""
    def body(y: str) -> str:
        reach = 2 * high
        window = f"slice({y}, greatest(1, i + 1 - {reach}), least(size({y}), i + 1 + {reach}) - greatest(1, i + 1 - {reach}) + 1)"
        best = let(window, "w", let("aggregate(w, 0D, (s, x) -> s + x * x)", "e", f"array_max(transform(sequence({low}, {high}), l -> case when l >= size(w) then 0D else {total('transform(sequence(0, size(w) - 1 - l), j -> w[j] * w[j + l])')} / (e + 1e-10D) end))"))
        raised = f"transform({y}, (x, i) -> x * (1 + {best}))"
        return let(raised, "u", let("array_max(u)", "m", "case when m > 0 then transform(u, x -> x / m) else u end"))

    return F.expr(bound(y, body))
