"""Events and segments: onsets, peaks, voice activity, silence, outliers, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wavemill.functions.arrays import let, mean, total
from wavemill.operators.lineage import cut


def in_time() -> WindowSpec:
    return Window.partitionBy("clip_id").orderBy("t")


def pick_peaks(y: str, before: int = 1, after: int = 1, avg_before: int = 3, avg_after: int = 3, delta: float = 0.07, wait: int = 1, least: float = 0.0) -> Column:
    """Strict local maxima of the min-max scaled envelope that reach the local mean plus ``delta``, ``wait`` frames apart."""
    scaled = let(f"array_min({y})", "lo", let(f"array_max({y})", "hi", f"case when hi > 1e-6D then transform({y}, x -> case when hi - lo > 1e-6D then (x - lo) / (hi - lo) else 0D end) else cast(array() as array<double>) end"))
    around = f"slice(e, greatest(1, i + 1 - {avg_before}), least(size(e), i + 1 + {avg_after}) - greatest(1, i + 1 - {avg_before}) + 1)"
    # The strongest neighbour, the frame itself left out.
    rival = f"greatest(array_max(slice(e, i + 1 - {before}, {before})), array_max(slice(e, i + 2, {after})))"
    test = f"{rival} < e[i] and e[i] >= {let(around, 'w', mean('w'))} + {delta!r}D and e[i] >= {least!r}D"
    greedy = f"aggregate(c, cast(array() as array<int>), (o, i) -> case when size(o) = 0 or i - element_at(o, -1) >= {wait} then concat(o, array(i)) else o end)"
    found = f"case when size(e) <= {before + after} then cast(array() as array<int>) else {let(f'filter(sequence({before}, size(e) - {after} - 1), i -> {test})', 'c', greedy)} end"
    return F.expr(let(scaled, "e", found))


def backtrack(y: str, peaks: str, reach: int) -> Column:
    """For each peak the lowest place on the way back, not further than ``reach`` nor past a rise of a tenth."""
    walk = f"aggregate(sequence(1, {reach}), named_struct('at', p, 'm', {y}[p], 'go', true), (a, k) -> case when not a.go or p - k < 0 then a when {y}[p - k] > 1.1D * a.m then named_struct('at', a.at, 'm', a.m, 'go', false) when {y}[p - k] < a.m then named_struct('at', p - k, 'm', {y}[p - k], 'go', true) else a end, a -> a.at)"
    return F.expr(f"transform({peaks}, p -> {walk})")


def onset_strength(frames: DataFrame, method: str = "flux") -> DataFrame:
    """(clip_id, t, strength) from magnitudes: flux, energy, hfc or rms; 0 for the first frame."""
    if method == "flux":
        gain = total("zip_with(v, b_, (x, y) -> greatest(0D, x - y))")
        return frames.withColumn("b_", F.lag("v").over(in_time())).select("clip_id", "t", F.expr(f"case when b_ is null then 0D else {gain} end").alias("strength"))
    level = {"energy": "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))", "hfc": total("transform(v, (x, i) -> i * x * x)"), "rms": "sqrt(aggregate(v, 0D, (s, x) -> s + x * x) / size(v))"}[method]
    rows = frames.select("clip_id", "t", F.expr(level).alias("e_")).withColumn("b_", F.lag("e_").over(in_time()))
    if method == "energy":
        out = F.when(F.col("b_").isNull(), 0.0).when(F.col("b_") > 1e-10, F.greatest(F.lit(0.0), (F.col("e_") - F.col("b_")) / F.col("b_"))).otherwise(F.when(F.col("e_") > 1e-10, 1.0).otherwise(0.0))
    else:
        out = F.when(F.col("b_").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("e_") - F.col("b_")))
    return rows.select("clip_id", "t", out.alias("strength"))


def complex_onset(spectra: DataFrame) -> DataFrame:
    """Distance of each frame from the one predicted by steady magnitude and phase advance."""
    polar = spectra.select("clip_id", "t", "re", "im", F.expr("zip_with(re, im, (a, b) -> sqrt(a * a + b * b))").alias("m"), F.expr("zip_with(re, im, (a, b) -> atan2(b, a))").alias("p"))
    rows = polar.withColumns({"m1": F.lag("m", 1).over(in_time()), "p1": F.lag("p", 1).over(in_time()), "p2": F.lag("p", 2).over(in_time())})
    away = total("transform(m1, (m, i) -> sqrt(power(re[i] - m * cos(2 * p1[i] - p2[i]), 2) + power(im[i] - m * sin(2 * p1[i] - p2[i]), 2)))")
    return rows.select("clip_id", "t", F.expr(f"case when p2 is null then 0D else {away} end").alias("strength"))


def multiband_onset(log_mel: DataFrame, n_mels: int, bands: int) -> DataFrame:
    """(clip_id, t, band, strength): mean rise in groups of mel bands, the last taking the remainder."""
    size = n_mels // bands
    rise = F.expr("case when b_ is null then transform(v, x -> 0D) else zip_with(v, b_, (x, y) -> greatest(0D, x - y)) end")
    rows = log_mel.withColumn("b_", F.lag("v").over(in_time())).withColumn("r_", rise)
    groups = F.expr("array(" + ", ".join(mean(f"slice(r_, {k * size + 1}, {size if k < bands - 1 else n_mels - k * size})") for k in range(bands)) + ")")
    return rows.select("clip_id", "t", F.posexplode(groups).alias("band", "strength"))


#: Frames of a clip that one task numbers.
STRETCH = 1 << 16


def running_total(rows: DataFrame, x: str, out: str, per: int = STRETCH) -> DataFrame:
    """``rows`` (clip_id, t, ...) with ``out``, the sum of ``x`` up to each row: inside stretches of a clip, and over the sums of stretches."""
    keyed = cut(rows.withColumn("b_", F.floor(F.col("t") / per)))  # read twice; without an end of its lineage, plans of several such steps would double each time
    earlier = Window.partitionBy("clip_id").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("clip_id", "b_").agg(F.sum(x).alias("s_")).select("clip_id", "b_", F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("o_"))
    inside = F.sum(x).over(Window.partitionBy("clip_id", "b_").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn(out, inside).join(sums, ["clip_id", "b_"]).withColumn(out, F.col(out) + F.col("o_")).drop("b_", "o_")


def previous(rows: DataFrame, x: str, out: str, per: int = STRETCH) -> DataFrame:
    """``rows`` (clip_id, t, ...) with ``out``, the value of ``x`` in the row before, null in a clip's first one; a stretch gets the last value before it."""
    keyed = cut(rows.withColumn("b_", F.floor(F.col("t") / per)))
    lasts = keyed.groupBy("clip_id", "b_").agg(F.max_by(F.struct(F.col(x).alias("x")), "t").alias("l_"))
    lasts = lasts.select("clip_id", "b_", F.lag("l_").over(Window.partitionBy("clip_id").orderBy("b_")).alias("p_"))
    before = F.lag(F.struct(F.col(x).alias("x"))).over(Window.partitionBy("clip_id", "b_").orderBy("t"))
    joined = keyed.withColumn("q_", before).join(lasts, ["clip_id", "b_"])
    return joined.withColumn(out, F.coalesce("q_", "p_")["x"]).drop("b_", "p_", "q_")


def islands(rows: DataFrame, flag: str, per: int = STRETCH) -> DataFrame:
    """``rows`` with island_, a number that is the same for neighbouring rows of the same flag."""
    marked = previous(rows.withColumn("k_", F.coalesce(F.col(flag).cast("int"), F.lit(-1))), "k_", "was_", per)
    changed = marked.withColumn("c_", F.when(F.col("was_") == F.col("k_"), 0).otherwise(1))
    return running_total(changed, "c_", "island_", per).drop("c_", "k_", "was_")


def of_clip(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    """``rows`` with values of their clip: aggregates that are partial before they meet, joined back."""
    rows = cut(rows)
    whole = rows.groupBy(F.col("clip_id").alias("c_id_")).agg(*(c.alias(n) for n, c in found.items()))
    return rows.join(whole, F.col("clip_id") == F.col("c_id_")).drop("c_id_")


def of_island(rows: DataFrame) -> DataFrame:
    """``rows`` with n_, the length of their island."""
    rows = cut(rows)
    sizes = rows.groupBy(F.col("clip_id").alias("c_id_"), F.col("island_").alias("i_id_")).agg(F.count(F.lit(1)).alias("n_"))
    return rows.join(sizes, (F.col("clip_id") == F.col("c_id_")) & (F.col("island_") == F.col("i_id_"))).drop("c_id_", "i_id_")


def smooth_activity(rows: DataFrame, min_speech: int, min_silence: int, flag: str = "active", per: int = STRETCH) -> DataFrame:
    """Speech runs that are too short go, then silence runs that are too short and lie between speech are filled."""
    rows = of_island(islands(rows, flag, per)).withColumn(flag, F.col(flag) & (F.col("n_") >= min_speech)).drop("island_", "n_")
    rows = of_clip(of_island(islands(rows, flag, per)), {"first_": F.min("island_"), "last_": F.max("island_")})
    inner = (F.col("island_") > F.col("first_")) & (F.col("island_") < F.col("last_"))
    return rows.withColumn(flag, F.col(flag) | (inner & (F.col("n_") < min_silence))).drop("n_", "island_", "first_", "last_")


def segments(rows: DataFrame, flag: str = "active", score: str | None = None, per: int = STRETCH) -> DataFrame:
    """(clip_id, seg_id, start, end, score) of runs of the flag: half-open frame ranges, with the mean score. What is numbered along a clip is its runs."""
    found = islands(rows, flag, per).where(flag).groupBy("clip_id", "island_").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), (F.avg(score) if score else F.lit(1.0)).alias("score"))
    return found.select("clip_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("start")) - 1).alias("seg_id"), "start", "end", "score")


def energy_activity(frames: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(clip_id, t, score): frame level over three times a threshold, which is at least a tenth of the clip's loudest."""
    level = of_clip(frames.select("clip_id", "t", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x) / size(v))").alias("r")), {"top_": F.max("r")})
    limit = F.greatest(F.lit(threshold), 0.1 * F.col("top_"))
    return level.withColumn("l", limit).select("clip_id", "t", F.when(F.col("r") > F.col("l"), F.least(F.lit(1.0), F.col("r") / (3 * F.col("l")))).otherwise(0.0).alias("score"))


def combined_activity(scores: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of scores of the same frames, over its largest in the clip."""
    parts = None
    for rows, weight in scores:
        one = rows.select("clip_id", "t", (F.col("score") * weight).alias("score"), F.lit(1).alias("k"))
        parts = one if parts is None else parts.unionAll(one)
    summed = of_clip(parts.groupBy("clip_id", "t").agg(F.sum("score").alias("s"), F.sum("k").alias("k")).where(F.col("k") == len(scores)), {"m": F.max("s")})
    return summed.select("clip_id", "t", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("score"))


def split_silence(frames: DataFrame, lengths: DataFrame, length: int, hop: int, db: float = 60.0) -> DataFrame:
    """(clip_id, seg_id, start, end) in samples: runs of frames within ``db`` of the loudest, gaps up to a hop merged.

    ``lengths``: (clip_id, n_samples).
    """
    level = frames.select("clip_id", "t", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x) / size(v))").alias("r"))
    loud = (F.col("r") >= F.col("top_") * 10 ** (-db / 20)) & (F.col("r") > 0)
    runs = segments(of_clip(level, {"top_": F.max("r")}).withColumn("active", loud)).join(lengths, "clip_id")
    spans = runs.select("clip_id", (F.col("start") * hop).alias("start"), F.least((F.col("end") - 1) * hop + length, F.col("n_samples")).alias("end"))
    w = Window.partitionBy("clip_id").orderBy("start")
    merged = spans.withColumn("c_", F.when(F.col("start") - F.lag("end").over(w) <= hop, 0).otherwise(1)).withColumn("g_", F.sum("c_").over(w)).groupBy("clip_id", "g_").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("clip_id", (F.row_number().over(w) - 1).alias("seg_id"), "start", "end")


def trim_silence(spans: DataFrame) -> DataFrame:
    """(clip_id, start, end): from the first span's start to the last one's end."""
    return spans.groupBy("clip_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def without_outliers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows within one and a half quartile ranges; quartiles are the values at a quarter and three quarters of the count. Null values go."""
    from wavemill.operators import order

    found = order.at(order.placed(rows, by, value), by, value, {"a_": F.floor(F.col("n_") / 4), "b_": F.floor(3 * F.col("n_") / 4)})
    marked = order.joined_to(rows, found, by, ["a_", "b_"])
    return marked.where(F.col(value).between(F.col("a_") - 1.5 * (F.col("b_") - F.col("a_")), F.col("b_") + 1.5 * (F.col("b_") - F.col("a_")))).drop("a_", "b_")
