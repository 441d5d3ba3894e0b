"""One value or vector a frame, from magnitudes or samples, and normalisation over frames, clips and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wavemill.functions.arrays import dot, let, literal, squares, total


def in_time() -> WindowSpec:
    return Window.partitionBy("clip_id").orderBy("t")


def clip() -> WindowSpec:
    return Window.partitionBy("clip_id")


def bin_hz(n_bins: int, sr: float, n_fft: int) -> str:
    return literal([k * sr / n_fft for k in range(n_bins)])


def _hz(sr: float, n_fft: int) -> str:
    return f"(i * {sr / n_fft!r}D)"


def centroid(sr: float, n_fft: int, v: str = "v") -> Column:
    """Mean frequency by magnitude; 0 for silence."""
    return F.expr(let(total(v), "s", f"case when s > 0 then {total(f'transform({v}, (x, i) -> x * {_hz(sr, n_fft)})')} / s else 0D end"))


def bandwidth(sr: float, n_fft: int, p: float = 2.0, norm: bool = True, v: str = "v") -> Column:
    """p-th moment about the centroid to the power 1/p."""
    c = f"case when s > 0 then {total(f'transform({v}, (x, i) -> x * {_hz(sr, n_fft)})')} / s else 0D end"
    body = total(f"transform({v}, (x, i) -> power(abs({_hz(sr, n_fft)} - c), {p!r}D) * x" + (" / s)" if norm else ")"))
    return F.expr(let(total(v), "s", let(c, "c", f"case when s > 0 then power({body}, {1 / p!r}D) else 0D end")))


def rolloff(sr: float, n_fft: int, part: float = 0.85, v: str = "v") -> Column:
    """Frequency below which ``part`` of the magnitude lies; 0 for silence."""
    walk = f"aggregate({v}, named_struct('s', 0D, 'n', 0), (a, x) -> named_struct('s', a.s + x, 'n', a.n + case when a.s + x < {part!r}D * s then 1 else 0 end), a -> a.n)"
    return F.expr(let(total(v), "s", f"case when s > 0 then {walk} * {sr / n_fft!r}D else 0D end"))


def flatness(power: float = 2.0, amin: float = 1e-10, v: str = "v") -> Column:
    """Geometric over arithmetic mean."""
    return F.expr(let(f"transform({v}, x -> greatest(power(x, {power!r}D), {amin!r}D))", "u", let(f"{total('u')} / size(u)", "m", f"case when m > {amin!r}D then exp({total('transform(u, x -> ln(x))')} / size(u)) / m else 0D end")))


def flux(frames: DataFrame) -> DataFrame:
    """flux: rises of magnitude since the frame before, summed; 0 for the first."""
    before = F.lag("v").over(in_time())
    return frames.withColumn("b_", before).withColumn("flux", F.expr(f"case when b_ is null then 0D else {total('zip_with(v, b_, (x, y) -> greatest(0D, x - y))')} end")).drop("b_")


def contrast(n_bins: int, sr: float, n_fft: int, bands: int = 6, f_min: float = 200.0, quantile: float = 0.02, v: str = "v") -> Column:
    """log10 of peak over valley in the band below ``f_min`` and octaves above it; 0 for a band without bins."""
    edges = [0] + [min(n_bins - 1, int(f_min * 2**i / (sr / n_fft))) for i in range(bands + 1)]
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = max(1, int((b - a) * quantile))
        low, high = f"{total(f'slice(s, 1, {n})')} / {n}", f"{total(f'slice(s, {b - a - n + 1}, {n})')} / {n}"
        parts.append("0D" if b <= a else let(f"array_sort(slice({v}, {a + 1}, {b - a}))", "s", f"log10(greatest({high}, 1e-10D)) - log10(greatest({low}, 1e-10D))"))
    return F.expr(f"array({', '.join(parts)})")


def rms(v: str = "v") -> Column:
    return F.expr(f"sqrt({squares(v)} / size({v}))")


def rms_db(v: str = "v", ref: float = 1.0, floor: float = -80.0) -> Column:
    return F.greatest(F.lit(floor), 20.0 * F.log10(F.greatest(rms(v), F.lit(1e-10)) / ref))


def crossings(v: str = "v", threshold: float = 1e-10) -> Column:
    """Places where the sign changes, the index of the later sample; values within the threshold are zero, not negative."""
    sign = f"transform({v}, x -> case when abs(x) <= {threshold!r}D then 0 when x < 0 then 1 else 0 end)"
    return F.expr(let(sign, "s", "filter(transform(s, (x, i) -> case when i > 0 and s[i - 1] <> x then i end), i -> i is not null)"))


def zero_crossing_rate(v: str = "v") -> Column:
    """Changes of sign over the frame's length."""
    return F.size(crossings(v)) / F.size(v)


def crossings_beyond(threshold: float, v: str = "v") -> Column:
    """Jumps from above +threshold to below -threshold or back between neighbouring samples."""
    return F.expr(f"size(filter(transform({v}, (x, i) -> i > 0 and ((x > {threshold!r}D and {v}[i - 1] < -{threshold!r}D) or (x < -{threshold!r}D and {v}[i - 1] > {threshold!r}D))), b -> b))")


def poly_features(frames: DataFrame, sr: float, n_fft: int, n_bins: int, order: int = 1) -> DataFrame:
    """v as the coefficients, highest first, of the least-squares polynomial of magnitude over frequency."""
    import numpy as np

    from wavemill.operators.spectral import apply_filterbank

    # The fit is linear in the magnitudes, so its pseudo-inverse is one more filterbank.
    return apply_filterbank(frames, np.linalg.pinv(np.vander(np.arange(n_bins) * sr / n_fft, order + 1)))


def correlation(a: str, b: str) -> Column:
    """Pearson; 0 where either is constant."""
    da, db = (let(f"{total(x)} / size({x})", "m", f"transform({x}, x -> x - m)") for x in (a, b))
    # Names that no column is likely to have: inside, a and b still mean columns.
    return F.expr(let(f"named_struct('a', {da}, 'b', {db})", "ab_", let(f"sqrt({squares('ab_.a')} * {squares('ab_.b')})", "n", f"case when n > 1e-10 then {dot('ab_.a', 'ab_.b')} / n else 0D end")))


def argmax(v: str = "v") -> Column:
    """Index of the first largest value."""
    return F.expr(f"array_position({v}, array_max({v})) - 1").cast("int")


def tall_values(frames: DataFrame) -> DataFrame:
    return frames.select("clip_id", "t", F.posexplode("v").alias("f", "x"))


def wide(values: DataFrame) -> DataFrame:
    """(clip_id, t, v) from (clip_id, t, f, x)."""
    made = values.groupBy("clip_id", "t").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("s_"))
    return made.select("clip_id", "t", F.expr("transform(s_, s -> s.x)").alias("v"))


def clip_statistics(frames: DataFrame) -> DataFrame:
    """(clip_id, f, mean, var): of each feature over a clip's frames; population variance."""
    return tall_values(frames).groupBy("clip_id", "f").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def global_statistics(frames: DataFrame) -> DataFrame:
    """(f, mean, var) over all clips, from sums and sums of squares that combine before the shuffle."""
    sums = tall_values(frames).groupBy("f").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    return sums.select("f", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))).alias("var"))


def normalise(frames: DataFrame, variance: bool = True, stats: DataFrame | None = None, floor: float = 1e-10) -> DataFrame:
    """Tall values (clip_id, t, f, x) less their mean, over their deviation: of the clip, or of given (f, mean, var)."""
    values = tall_values(frames)
    keys = ["clip_id", "f"] if stats is None else ["f"]
    joined = values.join(clip_statistics(frames) if stats is None else stats, keys)
    out = F.col("x") - F.col("mean")
    return joined.select("clip_id", "t", "f", (out / F.sqrt(F.greatest(F.col("var"), F.lit(floor))) if variance else out).alias("x"))


def min_max(frames: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Tall values scaled to a range by feature and clip; a constant feature lies in its middle."""
    values = tall_values(frames)
    ends = values.groupBy("clip_id", "f").agg(F.min("x").alias("a_"), F.max("x").alias("b_"))
    span = F.col("b_") - F.col("a_")
    out = F.when(span > 0, low + (F.col("x") - F.col("a_")) / span * (high - low)).otherwise((low + high) / 2)
    return values.join(ends, ["clip_id", "f"]).select("clip_id", "t", "f", out.alias("x"))


def unit_frames(v: str = "v") -> Column:
    return F.expr(let(f"sqrt(greatest({squares(v)}, 1e-10D))", "n", f"transform({v}, x -> x / n)"))
