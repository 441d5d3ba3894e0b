"""From signals to frames: windows, padding, framing, channels, PCM, levels.

A signal is a row (clip_id, y array<double>); a frame is a row (clip_id, t, v array<double>). Signals too long for a row
stay tall, (clip_id, n, x), and are framed by ``frame_tall``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.arrays import bound, let, mean, squares


def signals(rows: DataFrame, clip: str, order: list[str], value: str) -> DataFrame:
    """(clip_id, y) from a table of samples: one row a clip, samples in order."""
    made = rows.groupBy(F.col(clip).alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("x_")))).alias("s_"))
    return made.select("clip_id", F.expr("transform(s_, s -> s.x_)").alias("y"))


def tall(rows: DataFrame) -> DataFrame:
    """(clip_id, n, x) from (clip_id, y)."""
    return rows.select("clip_id", F.posexplode("y").alias("n", "x"))


def numbered(rows: DataFrame, clip: str, order: list[str], value: str, piece: Column) -> DataFrame:
    """(clip_id, n, x) from a table of samples of clips of any length: no clip is ever one row or one task.

    ``piece`` must not fall along ``order`` (a day, for instance). Samples are numbered inside a piece of a clip, and
    pieces are counted before that.
    """
    keyed = rows.select(F.col(clip).alias("clip_id"), piece.alias("p_"), *(F.col(c).alias(f"o{k}_") for k, c in enumerate(order)), F.col(value).cast("double").alias("x"))
    counts = keyed.groupBy("clip_id", "p_").agg(F.count(F.lit(1)).alias("c_"))
    before = Window.partitionBy("clip_id").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("clip_id", "p_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("b_"))
    own = Window.partitionBy("clip_id", "p_").orderBy(*(f"o{k}_" for k in range(len(order))))
    placed = keyed.withColumn("r_", F.row_number().over(own)).join(counts, ["clip_id", "p_"])
    return placed.select("clip_id", (F.col("b_") + F.col("r_") - 1).cast("int").alias("n"), "x")


def window_sql(kind: str, length: int | str, periodic: bool = True) -> str:
    """SQL of a window's samples: hann, hamming, blackman, bartlett or rectangular; the length is a number or SQL of a row's columns."""
    n = f"(cast({length} as double){'' if periodic else ' - 1'})"
    at = f"2 * pi() * i / {n}"
    body = {
        "hann": f"0.5D - 0.5D * cos({at})", "hamming": f"0.54D - 0.46D * cos({at})", "blackman": f"greatest(0D, 0.42D - 0.5D * cos({at}) + 0.08D * cos(2 * {at}))",
        "bartlett": f"1D - abs((i - {n} / 2D) / ({n} / 2D))", "rectangular": "1D",
    }[kind]
    if isinstance(length, int):
        return "cast(array() as array<double>)" if length == 0 else "array(1D)" if length == 1 else f"transform(sequence(0, {length - 1}), i -> cast({body} as double))"
    return f"case when {length} < 1 then cast(array() as array<double>) when {length} = 1 then array(1D) else transform(sequence(0, greatest(1, cast({length} as int) - 1)), i -> cast({body} as double)) end"


def window(kind: str, length: int | str, periodic: bool = True) -> Column:
    return F.expr(window_sql(kind, length, periodic))


def pad_sql(y: str, pad: int, mode: str = "constant", value: float = 0.0) -> str:
    """``pad`` samples on both sides. reflect wraps round where the signal is shorter than ``pad``; empty stays empty."""
    if pad == 0:
        return y
    left = {"constant": f"array_repeat({value!r}D, {pad})", "edge": f"array_repeat({y}[0], {pad})", "reflect": f"transform(sequence({pad}, 1, -1), i -> {y}[i % size({y})])"}[mode]
    right = {"constant": f"array_repeat({value!r}D, {pad})", "edge": f"array_repeat({y}[size({y}) - 1], {pad})", "reflect": f"transform(sequence(1, {pad}), i -> {y}[(size({y}) - 1) - (i % size({y}))])"}[mode]
    return f"case when size({y}) = 0 then {y} else concat({left}, {y}, {right}) end"


def frame(rows: DataFrame, length: int, hop: int, pad: int = 0, mode: str = "constant") -> DataFrame:
    """Frames that start every ``hop`` samples and lie inside the (padded) signal; none if it is shorter than one.

    Signals are arrays, (clip_id, y), or tall, (clip_id, n, x): these are framed by blocks, see ``frame_tall``.
    """
    if "y" not in rows.columns:
        return frame_tall(rows, length, hop, pad, mode)
    padded = rows.select("clip_id", F.expr(let("y", "y", pad_sql("y", pad, mode))).alias("p_")).where(F.size("p_") >= length)
    starts = F.expr(f"transform(sequence(0, cast(floor((size(p_) - {length}) / {hop}) as int)), t -> slice(p_, t * {hop} + 1, {length}))")
    return padded.select("clip_id", F.posexplode(starts).alias("t", "v"))


def frame_tall(samples: DataFrame, length: int, hop: int, pad: int = 0, mode: str = "constant") -> DataFrame:
    """Frames of signals of any length, from (clip_id, n, x), with ``pad`` zeros or reflected samples at both ends; incomplete frames are left out.

    Samples meet in blocks and frames are cut where their first sample is, so a clip is spread over as many tasks as it has blocks.
    """
    from wavemill.operators.blocks import SAMPLES, frames_of, sample_blocks

    size = max(SAMPLES, 16 * length)
    return frames_of(sample_blocks(samples, size), length, hop, pad, size, mode)


def apply_window(frames: DataFrame, kind: str, win_length: int | None = None, length: int | None = None) -> DataFrame:
    """v times a window; one shorter than the frame covers its first samples and the rest is zero."""
    w = window_sql(kind, win_length or length)
    return frames.withColumn("v", F.expr(let(w, "w", "transform(v, (x, i) -> case when i < size(w) then x * w[i] else 0D end)")))


def mono(channels: str = "channels") -> Column:
    """Mean of channels; of unequal ones the first."""
    return F.expr(f"case when exists({channels}, c -> size(c) <> size({channels}[0])) then {channels}[0] else transform({channels}[0], (x, i) -> aggregate({channels}, 0D, (s, c) -> s + c[i]) / size({channels})) end")


def mix_stereo(left: str, right: str, left_weight: float = 0.5, right_weight: float = 0.5) -> Column:
    return F.expr(f"transform(sequence(0, least(size({left}), size({right})) - 1), i -> {left}[i] * {left_weight!r}D + {right}[i] * {right_weight!r}D)")


def to_stereo(y: str = "y") -> Column:
    return F.expr(f"array({y}, {y})")


def interleave(channels: str = "channels") -> Column:
    return F.expr(f"flatten(transform({channels}[0], (x, i) -> transform({channels}, c -> c[i])))")


def deinterleave(y: str, channels: int) -> Column:
    """Whole frames only; a remainder is dropped."""
    frames = f"cast(floor(size({y}) / {channels}) as int)"
    return F.expr(f"transform(sequence(0, {channels - 1}), c -> case when {frames} = 0 then cast(array() as array<double>) else transform(sequence(0, {frames} - 1), i -> {y}[i * {channels} + c]) end)")


PCM = {16: 32767.0, 24: 8388607.0, 32: 2147483647.0}


def pcm_encode(y: str = "y", bits: int = 16) -> Column:
    return F.expr(f"transform({y}, x -> cast(greatest(-1D, least(1D, x)) * {PCM[bits]!r}D as bigint))")


def pcm_decode(codes: str, bits: int = 16) -> Column:
    return F.expr(f"transform({codes}, x -> x / {PCM[bits]!r}D)")


def peak_normalise(y: str = "y") -> Column:
    return F.expr(let(f"array_max(transform({y}, x -> abs(x)))", "m", f"case when m > 0 then transform({y}, x -> x / m) else {y} end"))


def rms_normalise(y: str = "y", target: float = 0.1) -> Column:
    return F.expr(let(f"sqrt({squares(y)} / size({y}))", "r", f"case when r > 0 then transform({y}, x -> x * {target!r}D / r) else {y} end"))


def fit_length(y: str, length: int, mode: str = "constant") -> Column:
    """Cut out the middle, or pad both ends, the odd sample at the end."""
    cut = f"slice({y}, cast(floor((size({y}) - {length}) / 2) as int) + 1, {length})"
    need = f"({length} - size({y}))"
    low = f"cast(floor({need} / 2) as int)"
    side = {"constant": ("0D", "0D"), "edge": (f"{y}[0]", f"{y}[size({y}) - 1]")}[mode]
    return F.expr(f"case when size({y}) >= {length} then {cut} else concat(array_repeat({side[0]}, {low}), {y}, array_repeat({side[1]}, {need} - {low})) end")


def time_shift(y: str, shift: int, wrap: bool = False) -> Column:
    """Later by ``shift`` samples, earlier if negative; what falls off returns at the other end or is silence."""
    def body(y: str) -> str:
        source = f"i - ({shift})"
        value = f"{y}[pmod({source}, size({y}))]" if wrap else f"case when {source} between 0 and size({y}) - 1 then {y}[{source}] else 0D end"
        return f"transform({y}, (x, i) -> {value})"

    return F.expr(bound(y, body))


def time_warp(y: str, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear resampling of time: ``points`` pair output and input places, both from 0 to 1."""
    def body(y: str) -> str:
        pos = "cast(i as double) / greatest(1, size({y}) - 1)".format(y=y)
        at = f"{points[-1][1]!r}D"
        for (a, b), (c, d) in reversed(list(zip(points[:-1], points[1:], strict=True))):
            at = f"case when {pos} <= {c!r}D then {b!r}D + ({pos} - {a!r}D) * {(d - b) / (c - a)!r}D else {at} end"
        return f"transform({y}, (x, i) -> {let(f'({at}) * (size({y}) - 1)', 'u', f'{y}[cast(floor(u) as int)] + (u - floor(u)) * ({y}[least(size({y}) - 1, cast(floor(u) as int) + 1)] - {y}[cast(floor(u) as int)])')})"

    return F.expr(bound(y, body))


def resample_linear(y: str, rate: float) -> Column:
    """``rate`` times as many samples by linear interpolation."""
    def body(y: str) -> str:
        u = f"(i / {rate!r}D)"
        return f"case when size({y}) = 0 then {y} else transform(sequence(0, greatest(0, cast(floor(size({y}) * {rate!r}D) as int) - 1)), i -> {let(f'least(cast(floor{u} as int), size({y}) - 1)', 'k', f'{y}[k] + ({u} - k) * ({y}[least(size({y}) - 1, k + 1)] - {y}[k])')}) end"

    return F.expr(bound(y, body))


def center(y: str = "y") -> Column:
    return F.expr(let(mean(y), "m", f"transform({y}, x -> x - m)"))


def chunk_rows(clips: DataFrame, size: int) -> DataFrame:
    """(clip_id, seq, y, last): samples in chunks, as a stream brings them, of arrays (clip_id, y) or of tall samples (clip_id, n, x)."""
    if "y" not in clips.columns:
        from wavemill.operators.blocks import sample_blocks, with_neighbours

        made = with_neighbours(sample_blocks(clips, size), size, 0, 1)
        return made.select("clip_id", F.col("b_").cast("int").alias("seq"), F.col("own_").alias("y"), F.col("next_").isNull().alias("last"))
    parts = F.expr(f"transform(sequence(0, cast(floor((size(y) - 1) / {size}) as int)), k -> named_struct('y', slice(y, k * {size} + 1, {size}), 'last', (k + 1) * {size} >= size(y)))")
    return clips.where(F.size("y") > 0).select("clip_id", F.posexplode(parts).alias("seq", "p")).select("clip_id", "seq", "p.y", "p.last")
