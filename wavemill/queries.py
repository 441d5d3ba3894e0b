"""Queries over the test tables, one or more an operator, and SQL that gives the same rows.

Signals: a clip is an embedding (64 samples) or a user's event values in order of time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import units
from wavemill.operators import alignment as warping
from wavemill.operators import augment, decompose, events, features, frames, pitch, rates, recurrent, similarity, spectral, statistics, temporal
from wavemill.plans import chains

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SR, N, HOP = 64.0, 16, 4


def query(sql: str | None = None):
    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("y"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.signals(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' samples as tall rows (clip_id, n, x), numbered hour by hour."""
    return frames.numbered(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", F.date_trunc("hour", "ts"))


def tall_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' samples as tall values: time is the sample number, one feature."""
    return samples(spark, sf_dir).select("clip_id", F.col("n").alias("t"), F.lit(0).alias("f"), "x")


def r6(c) -> F.Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(0.0), 6)


def points(rows: DataFrame, column: str, *keys: str, name: str = "i", value: str = "x") -> DataFrame:
    """An array column as rows (keys, i, x)."""
    return rows.select(*keys, F.posexplode(column).alias(name, value)).withColumn(value, r6(F.col(value).cast("double")))


def tall_rounded(rows: DataFrame, value: str = "x") -> DataFrame:
    return rows.withColumn(value, r6(value))


def magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.magnitude_frames(emb(spark, sf_dir), N, HOP, center=False)


# The same frames and spectra, as joins and sums.
E_S = "s as (select vec_id as clip_id, unnest(range(len(embedding))) as n, cast(unnest(embedding) as double) as x from embeddings)"
U_S = "s as (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as x from events)"
E_F = f"{E_S}, fr as (select clip_id, t, n - t * {HOP} as i, x from s join (select unnest(range(13)) as t) on n between t * {HOP} and t * {HOP} + {N - 1})"
E_C = f"""{E_F}, c as (select clip_id, t, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / {N})) * cos(2 * pi() * k * i / {N})) as re, -sum(x * (0.5 - 0.5 * cos(2 * pi() * i / {N})) * sin(2 * pi() * k * i / {N})) as im
from fr cross join (select unnest(range({N // 2 + 1})) as k) group by clip_id, t, k)"""
E_M = f"{E_C}, m as (select clip_id, t, k, sqrt(re * re + im * im) as v, k * {SR / N} as f from c)"
FS = "select cast(clip_id as bigint) as clip_id, cast(t as integer) as t, "


@query(f"with {E_C} select clip_id, cast(t as integer) as t, cast(k as integer) as k, round(re + 0.0, 6) + 0.0 as re, round(im + 0.0, 6) + 0.0 as im from c")
def stft(spark, sf_dir):
    s = spectral.stft(emb(spark, sf_dir), N, HOP, center=False)
    z = s.select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return z.select("clip_id", "t", "k", (r6("z.re") + 0.0).alias("re"), (r6("z.im") + 0.0).alias("im"))


@query(f"with {E_C} select clip_id, cast(t as integer) as t, cast(k as integer) as k, round(re * re + im * im, 6) as p from c")
def power_spectrum(spark, sf_dir):
    return points(spectral.power_frames(emb(spark, sf_dir), N, HOP, center=False), "v", "clip_id", "t", name="k", value="p")


@query(f"with {E_M} {FS} round(case when sum(v) > 0 then sum(f * v) / sum(v) else 0 end, 6) as centroid from m group by all")
def spectral_centroid(spark, sf_dir):
    return magnitudes(spark, sf_dir).select("clip_id", "t", r6(features.centroid(SR, N)).alias("centroid"))


@query(f"with {E_M}, c0 as (select clip_id, t, sum(f * v) / sum(v) as c, sum(v) as s from m group by all) {FS} round(sqrt(sum(pow(f - c, 2) * v / s)), 6) as bandwidth from m join c0 using (clip_id, t) group by all")
def spectral_bandwidth(spark, sf_dir):
    return magnitudes(spark, sf_dir).select("clip_id", "t", r6(features.bandwidth(SR, N)).alias("bandwidth"))


@query(f"with {E_M}, q as (select *, sum(v) over (partition by clip_id, t order by k) as cs, sum(v) over (partition by clip_id, t) as s from m) {FS} round(min(case when cs >= 0.85 * s then f end), 6) as rolloff from q group by all")
def spectral_rolloff(spark, sf_dir):
    return magnitudes(spark, sf_dir).select("clip_id", "t", r6(features.rolloff(SR, N)).alias("rolloff"))


@query(f"with {E_M} {FS} round(case when avg(greatest(v * v, 1e-10)) > 1e-10 then exp(avg(ln(greatest(v * v, 1e-10)))) / avg(greatest(v * v, 1e-10)) else 0 end, 6) as flatness from m group by all")
def spectral_flatness(spark, sf_dir):
    return magnitudes(spark, sf_dir).select("clip_id", "t", r6(features.flatness()).alias("flatness"))


@query(f"with {E_M}, d as (select clip_id, t, v - lag(v) over (partition by clip_id, k order by t) as d from m) {FS} round(coalesce(sum(greatest(d, 0)), 0), 6) as flux from d group by all")
def spectral_flux(spark, sf_dir):
    return features.flux(magnitudes(spark, sf_dir)).select("clip_id", "t", r6("flux").alias("flux"))


@query(f"""with {E_M}, b as (select clip_id, t, v, case when k < 1 then 0 when k < 2 then 1 when k < 4 then 2 else 3 end as band from m where k < 8)
select clip_id, cast(t as integer) as t, cast(band as integer) as band, round(log10(greatest(max(v), 1e-10)) - log10(greatest(min(v), 1e-10)), 6) + 0.0 as contrast from b group by all""")
def spectral_contrast(spark, sf_dir):
    m = magnitudes(spark, sf_dir).select("clip_id", "t", features.contrast(N // 2 + 1, SR, N, bands=3, f_min=4.0).alias("c"))
    return points(m, "c", "clip_id", "t", name="band", value="contrast").withColumn("contrast", F.col("contrast") + 0.0)


@query(f"with {E_F} {FS} round(sqrt(avg(x * x)), 6) as rms, round(greatest(-80, 20 * log10(greatest(sqrt(avg(x * x)), 1e-10))), 6) as db from fr group by all")
def rms(spark, sf_dir):
    return frames.frame(emb(spark, sf_dir), N, HOP).select("clip_id", "t", r6(features.rms()).alias("rms"), r6(features.rms_db()).alias("db"))


@query(f"with {E_F}, g as (select clip_id, t, i, x < -1e-10 as neg from fr), d as (select clip_id, t, neg <> lag(neg) over (partition by clip_id, t order by i) as c from g) {FS} round(count(*) filter (c) / {N}, 6) as zcr from d group by all")
def zero_crossing_rate(spark, sf_dir):
    return frames.frame(emb(spark, sf_dir), N, HOP).select("clip_id", "t", r6(features.zero_crossing_rate()).alias("zcr"))


@query(f"with {E_M} {FS} round(regr_slope(v, f), 5) + 0.0 as slope, round(regr_intercept(v, f), 5) + 0.0 as intercept from m group by clip_id, t")
def poly_features(spark, sf_dir):
    p = features.poly_features(magnitudes(spark, sf_dir), SR, N, N // 2 + 1)
    return p.select("clip_id", "t", (F.round(F.col("v")[0], 5) + 0.0).alias("slope"), (F.round(F.col("v")[1], 5) + 0.0).alias("intercept"))


@query("""select p_partkey, round(case when f < 1000 then f / (200.0 / 3) else 15 + ln(f / 1000) / (ln(6.4) / 27) end, 6) as mel, round(2595 * log10(1 + f / 700), 6) as htk, round(1127 * ln(1 + f / 700), 6) as kaldi,
round(f, 6) as back, round(69 + 12 * log2(f / 440), 6) as midi, round(24.7 * (4.37 * f / 1000 + 1), 9) as erb, cast(trunc(f * 22050 / 512) as bigint) as frame, round(10 * log10(greatest(f, 1e-10)), 6) as db
from (select p_partkey, p_retailprice as f from part)""")
def unit_conversions(spark, sf_dir):
    f = F.col("p_retailprice")
    mel = units.hz_to_mel(f)
    return read(spark, sf_dir, "part").select(
        "p_partkey", r6(mel).alias("mel"), r6(units.hz_to_mel(f, htk=True)).alias("htk"), r6(units.hz_to_mel_kaldi(f)).alias("kaldi"), r6(units.mel_to_hz(mel)).alias("back"),
        r6(units.hz_to_midi(f)).alias("midi"), F.round(units.erb(f), 9).alias("erb"), units.times_to_frames(f, 22050, 512).alias("frame"), r6(units.power_to_db(f)).alias("db"),
    )


@query("""with q as (select p_partkey, p_retailprice as f, p_retailprice * p_retailprice as q from part)
select p_partkey, round(20 * log10(pow(12194.217, 2) * q * q / ((q + pow(20.598997, 2)) * sqrt((q + pow(107.65265, 2)) * (q + pow(737.86223, 2))) * (q + pow(12194.217, 2)))) + 1.9997, 6) as a,
round(20 * log10(pow(12194.217, 2) * q * f / ((q + pow(20.598997, 2)) * sqrt(q + pow(107.65265, 2)) * (q + pow(12194.217, 2)))) + 0.17, 6) as b,
round(20 * log10(pow(12194.217, 2) * q / ((q + pow(20.598997, 2)) * (q + pow(12194.217, 2)))) + 0.0619, 6) as c from q""")
def weighting_curves(spark, sf_dir):
    f = F.col("p_retailprice")
    return read(spark, sf_dir, "part").select("p_partkey", *(r6(units.weighting(f, c)).alias(c) for c in "abc"))


@query("""select o_orderkey, case when m < 0 then '?' else list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], cast(m % 12 + 1 as integer)) || cast(m // 12 - 1 as varchar) end as note
from (select o_orderkey, cast(round(69 + 12 * log2(o_totalprice / 440)) as integer) as m from orders where o_totalprice > 0)""")
def note_names(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", units.hz_to_note(F.col("o_totalprice")).alias("note"))


@query(f"""with {U_S}, z as (select *, count(*) over (partition by clip_id) as len from s), p as (select clip_id, n + 8 as n, x from z union all select clip_id, 8 - n, x from z where n between 1 and 8 union all select clip_id, len - 1 + 8 + (len - 1 - n), x from z where n between len - 9 and len - 2),
l as (select clip_id, max(n) + 1 as len from p group by 1) select clip_id, cast(t as integer) as t, cast(p.n - t * 8 as integer) as i, round(x, 6) as x from p join l using (clip_id) join (select unnest(range(40)) as t) on p.n between t * 8 and t * 8 + 15 and t * 8 + 16 <= len""")
def framing_reflect(spark, sf_dir):
    return points(frames.frame(samples(spark, sf_dir), 16, 8, 8, "reflect"), "v", "clip_id", "t")


@query(f"""with {U_S}, l as (select clip_id, count(*) as len from s group by 1) select clip_id, cast(t as integer) as t, cast(n - t * 8 as integer) as i, round(x, 6) as x from s join l using (clip_id) join (select unnest(range(40)) as t) on n between t * 8 and t * 8 + 15 and t * 8 + 16 <= len""")
def framing_tall(spark, sf_dir):
    return points(frames.frame_tall(samples(spark, sf_dir), 16, 8), "v", "clip_id", "t")


@query(f"with {E_S} select clip_id, cast(n as integer) as i, round(trunc(greatest(-1, least(1, x)) * 32767) / 32767, 6) + 0.0 as x from s")
def pcm_round_trip(spark, sf_dir):
    coded = emb(spark, sf_dir).withColumn("c", frames.pcm_encode("y")).withColumn("d", frames.pcm_decode("c"))
    return points(coded, "d", "clip_id").withColumn("x", F.col("x") + 0.0)


@query(f"with {E_S} select clip_id, cast(n as integer) as i, round(x / max(abs(x)) over (partition by clip_id), 6) as peak, round(x * 0.1 / sqrt(avg(x * x) over (partition by clip_id)), 6) as level from s")
def level_normalise(spark, sf_dir):
    rows = emb(spark, sf_dir).select("clip_id", F.posexplode(F.arrays_zip(frames.peak_normalise().alias("a"), frames.rms_normalise().alias("b"))).alias("i", "z"))
    return rows.select("clip_id", "i", r6("z.a").alias("peak"), r6("z.b").alias("level"))


@query(f"with {E_S} select clip_id, cast(n - 12 as integer) as i, round(x, 6) as x from s where n between 12 and 51 ")
def fit_length(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", frames.fit_length("y", 40)), "z", "clip_id")


@query(f"with {E_S} select clip_id, cast((n + 5) % 64 as integer) as i, round(x, 6) as x from s")
def time_shift(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", frames.time_shift("y", 5, wrap=True)), "z", "clip_id")


@query(f"with {E_S}, u as (select unnest(range(96)) as i) select a.clip_id, cast(i as integer) as i, round(a.x + (i / 1.5 - a.n) * (b.x - a.x), 6) as x from u join s a on a.n = least(63, floor(i / 1.5)) join s b on b.clip_id = a.clip_id and b.n = least(63, a.n + 1)")
def resample_linear(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", frames.resample_linear("y", 1.5)), "z", "clip_id")


@query(f"with {U_S}, e as (select *, first_value(x) over w as a, last_value(x) over w as b from s window w as (partition by clip_id order by n rows between unbounded preceding and unbounded following)) select clip_id, cast(n as integer) as t, round((coalesce(lead(x) over v, b) - coalesce(lag(x) over v, a) + 2 * (coalesce(lead(x, 2) over v, b) - coalesce(lag(x, 2) over v, a))) / 10, 6) as dx from e window v as (partition by clip_id order by n)")
def delta_clamped(spark, sf_dir):
    return temporal.delta_clamped(tall_users(spark, sf_dir), 5).select("clip_id", "t", r6("dx").alias("dx"))


@query(f"""with {U_S}, e as (select *, count(*) over (partition by clip_id) as len from s), h as (select clip_id, regr_slope(x, n) filter (n < 5) as hs, regr_slope(x, n) filter (n >= len - 5) as ts from e group by 1)
select clip_id, cast(n as integer) as t, round(case when n < 2 then hs when n >= len - 2 then ts else d end, 6) as dx from (select *, (lead(x) over v - lag(x) over v + 2 * (lead(x, 2) over v - lag(x, 2) over v)) / 10 as d from e window v as (partition by clip_id order by n)) join h using (clip_id)""")
def delta(spark, sf_dir):
    return temporal.delta(tall_users(spark, sf_dir), 5).select("clip_id", "t", r6("dx").alias("dx"))


@query(f"with {U_S} select clip_id, cast(n as integer) as t, round(x, 6) as s0, round(coalesce(lag(x, 2) over v, 0), 6) as s1, round(coalesce(lag(x, 4) over v, 0), 6) as s2 from s window v as (partition by clip_id order by n)")
def stack_memory(spark, sf_dir):
    return temporal.stack(tall_users(spark, sf_dir), 3, 2).select("clip_id", "t", *(r6(c).alias(c) for c in ("s0", "s1", "s2")))


@query(f"""with {U_S}, m as (select a.clip_id, a.n, any_value(a.x) as x, sum(0.2 * pow(0.8, a.n - b.n) * b.x) + any_value(pow(0.8, a.n + 1)) as m from s a join s b on a.clip_id = b.clip_id and b.n <= a.n group by a.clip_id, a.n)
select clip_id, cast(n as integer) as t, round(sqrt(2) * (exp(0.5 * ln(1 + x * exp(-0.98 * (ln(1e-6) + ln(1 + m / 1e-6))) / 2)) - 1), 6) as x from m""")
def pcen(spark, sf_dir):
    return temporal.pcen(tall_users(spark, sf_dir), b=0.2).select("clip_id", F.col("t").cast("int").alias("t"), r6("y").alias("x"))


@query(f"with {U_S} select clip_id, cast(n as integer) as i, round(case when n = 0 then x + (2 * x - lead(x) over v) else x - 0.97 * lag(x) over v end, 6) as x from s window v as (partition by clip_id order by n)")
def preemphasis(spark, sf_dir):
    return tall_rounded(temporal.preemphasis_tall(samples(spark, sf_dir))).withColumn("n", F.col("n").cast("int")).withColumnRenamed("n", "i")


@query(f"with {U_S} select clip_id, cast(n as integer) as i, round(x, 4) as x from s")
def deemphasis_round_trip(spark, sf_dir):
    z = users(spark, sf_dir).select("clip_id", temporal.preemphasis().alias("y"))
    return temporal.deemphasis(z).select("clip_id", F.posexplode("y").alias("i", "x")).withColumn("x", F.round("x", 4))


@query(f"with {U_S}, w as (select clip_id, n, list_sort(list(x) over (partition by clip_id order by n rows between 3 preceding and 3 following)) as l from s) select clip_id, cast(n as integer) as i, round(l[len(l) // 2 + 1], 6) as x from w")
def median_filter(spark, sf_dir):
    return tall_rounded(temporal.median_filter_tall(samples(spark, sf_dir), 7)).withColumn("n", F.col("n").cast("int")).withColumnRenamed("n", "i")


@query("with s as (select label as clip_id, vec_id as t, unnest(range(len(embedding))) as f, cast(unnest(embedding) as double) as x from embeddings) select clip_id, cast(t as bigint) as t, cast(f as integer) as f, round((x - avg(x) over w) / sqrt(greatest(var_pop(x) over w, 1e-10)), 5) as x from s window w as (partition by clip_id, f)")
def normalise_features(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("v"))
    return features.normalise(rows).withColumn("x", F.round("x", 5))


@query("with s as (select unnest(range(len(embedding))) as f, cast(unnest(embedding) as double) as x from embeddings) select cast(f as integer) as f, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from s group by f")
def global_statistics(spark, sf_dir):
    rows = emb(spark, sf_dir).select("clip_id", F.lit(0).alias("t"), F.col("y").alias("v"))
    return features.global_statistics(rows).select("f", r6("mean").alias("mean"), r6("var").alias("var"))


@query("with s as (select label as clip_id, vec_id as t, unnest(range(len(embedding))) as f, cast(unnest(embedding) as double) as x from embeddings) select clip_id, cast(t as bigint) as t, cast(f as integer) as f, round((x - min(x) over w) / (max(x) over w - min(x) over w), 6) as x from s window w as (partition by clip_id, f)")
def min_max_features(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("v"))
    return tall_rounded(features.min_max(rows))


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as min, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max from events group by 1")
def run_statistics(spark, sf_dir):
    rows = statistics.summary(read(spark, sf_dir, "events"), ["event_type"], "value")
    return rows.select("event_type", "n", *(r6(c).alias(c) for c in ("mean", "sd", "min", "p50", "p90", "p95", "p99", "max")))


@query("""with h as (select event_type, event_id % 2 as h, count(*) as n, avg(value) as m, stddev_samp(value) as s from events group by 1, 2), j as (select a.event_type, a.m, b.m as b, (a.m - b.m) / b.m as c, abs(a.m - b.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n) as t from h a join h b on a.event_type = b.event_type and a.h = 0 and b.h = 1)
select event_type, round(m, 6) as mean, round(b, 6) as baseline, round(c, 6) as change, case when t >= 2 and c > 0.01 then 'regression' when t >= 2 and c < -0.01 then 'improvement' else 'unchanged' end as verdict from j""")
def compare_baseline(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    now, before = (statistics.summary(ev.where(F.col("event_id") % 2 == k), ["event_type"], "value") for k in (0, 1))
    c = statistics.compare(now, before, "event_type", 0.01)
    return c.select("event_type", r6("mean").alias("mean"), r6("baseline").alias("baseline"), r6("change").alias("change"), "verdict")


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by value) - 1 as i, count(*) over (partition by user_id) as n from events), q as (select user_id, max(value) filter (i = floor(n * 0.95)) as p95, max(value) filter (i = floor(n * 0.99)) as p99, avg(value) as mean from r group by 1)
select user_id, round(mean, 6) as mean, round(p95, 6) as p95, round(p99, 6) as p99, p95 <= 100 as in_time from q""")
def latency_statistics(spark, sf_dir):
    return statistics.latency(read(spark, sf_dir, "events"), ["user_id"], "value", 100.0).select("user_id", r6("mean").alias("mean"), r6("p95").alias("p95"), r6("p99").alias("p99"), "in_time")


@query("""with r as (select *, row_number() over (partition by user_id order by value) - 1 as i, count(*) over (partition by user_id) as n from events), q as (select user_id, max(value) filter (i = n // 4) as a, max(value) filter (i = 3 * n // 4) as b from r group by 1)
select event_id, user_id, round(value, 6) as value from r join q using (user_id) where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)""")
def without_outliers(spark, sf_dir):
    return events.without_outliers(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value").withColumn("value", r6("value"))


ACTIVE = f"{U_S}, a as (select clip_id, n as t, x, x > 50 as active from s), g as (select *, n0 - row_number() over (partition by clip_id, active order by t) as isl from (select *, row_number() over (partition by clip_id order by t) as n0 from a))"


@query(f"with {ACTIVE} select clip_id, cast(row_number() over (partition by clip_id order by min(t)) - 1 as integer) as seg_id, cast(min(t) as integer) as start, cast(max(t) + 1 as integer) as \"end\", round(avg(x), 6) as score from g where active group by clip_id, isl")
def segments(spark, sf_dir):
    rows = tall_users(spark, sf_dir).withColumn("active", F.col("x") > 50)
    return events.segments(rows, "active", "x").withColumn("score", r6("score"))


@query(f"""with {ACTIVE}, k as (select clip_id, t, x, active and count(*) over (partition by clip_id, active, isl) >= 2 as active from g),
g2 as (select *, n0 - row_number() over (partition by clip_id, active order by t) as isl from (select *, row_number() over (partition by clip_id order by t) as n0 from k)),
e as (select clip_id, active, isl, min(t) as a, max(t) as b, count(*) as n from g2 group by all), l as (select clip_id, min(a) as lo, max(b) as hi from e group by 1)
select g2.clip_id, cast(t as integer) as t, g2.active or (a > lo and b < hi and n < 3) as active from g2 join e using (clip_id, active, isl) join l on l.clip_id = g2.clip_id""")
def smooth_activity(spark, sf_dir):
    rows = tall_users(spark, sf_dir).withColumn("active", F.col("x") > 50)
    return events.smooth_activity(rows, 2, 3).select("clip_id", "t", "active")


@query(f"with {E_M}, e as (select clip_id, t, sum(k * v * v) as e from m group by all) {FS} round(coalesce(greatest(0, e - lag(e) over (partition by clip_id order by t)), 0), 6) as strength from e")
def onset_strength_hfc(spark, sf_dir):
    return events.onset_strength(magnitudes(spark, sf_dir), "hfc").withColumn("strength", r6("strength"))


@query(f"with {E_M}, e as (select clip_id, t, sqrt(sum(v * v)) as e from m group by all), l as (select *, lag(e) over (partition by clip_id order by t) as b from e) {FS} round(case when b is null then 0 when b > 1e-10 then greatest(0, (e - b) / b) when e > 1e-10 then 1 else 0 end, 6) as strength from l")
def onset_strength_energy(spark, sf_dir):
    return events.onset_strength(magnitudes(spark, sf_dir), "energy").withColumn("strength", r6("strength"))


V = "v as (select label as clip_id, row_number() over (partition by label order by vec_id) - 1 as t, embedding as v from embeddings)"


def labelled_frames(spark, sf_dir):
    from pyspark.sql import Window

    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), t.alias("t"), F.col("embedding").cast("array<double>").alias("v"))


DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(cast(z[1] as double) - cast(z[2] as double), 2))))"
BAND = f"{V}, p as (select a.clip_id, a.t as i, b.t as j, {DIST} as dist from v a join v b on a.clip_id = b.clip_id and a.t <> b.t and abs(a.t - b.t) <= 5)"


@query(f"with {BAND}, r as (select *, row_number() over (partition by clip_id, i order by dist, j) as rank from p) select clip_id, cast(i as integer) as i, cast(j as integer) as j, round(dist, 6) as dist, cast(rank as integer) as rank from r where rank <= 3")
def neighbours_in_band(spark, sf_dir):
    return tall_rounded(similarity.nearest_in_band(labelled_frames(spark, sf_dir), 5, 3), "dist")


@query(f"with {BAND}, r as (select *, row_number() over (partition by clip_id, i order by dist, j) as rank from p), m as (select r.clip_id, i, unnest(range(64)) as f, cast(unnest(v.v) as double) as x from r join v on v.clip_id = r.clip_id and v.t = r.j where rank <= 3) select clip_id, cast(i as integer) as t, cast(f as integer) as f, round(avg(x), 6) as x from m group by all")
def neighbour_filter(spark, sf_dir):
    return points(similarity.neighbour_filter(labelled_frames(spark, sf_dir), 5, 3, "mean", "euclidean"), "v", "clip_id", "t", name="f")


@query(f"with {BAND} select clip_id, cast(i as integer) as i, cast(j as integer) as j, round(dist, 6) as dist from p where dist <= 10")
def recurrence_links(spark, sf_dir):
    return tall_rounded(similarity.recurrence(labelled_frames(spark, sf_dir), width=5, threshold=10.0), "dist")


@query(f"with {E_M}, g as (select clip_id, case when t < 5 then 0 when t < 9 then 1 else 2 end as seg, k, v from m) select clip_id, cast(seg as integer) as seg, cast(k as integer) as f, round(avg(v), 6) as x from g group by all")
def synchronise(spark, sf_dir):
    bounds = emb(spark, sf_dir).select("clip_id", F.explode(F.array(F.lit(5), F.lit(9))).alias("b"))
    return points(similarity.synchronise(magnitudes(spark, sf_dir), bounds), "v", "clip_id", "seg", name="f")


@query(f"with {E_S} select clip_id, cast(n as bigint) as n, round(x, 6) + 0.0 as x from s where n < 64")
def istft_round_trip(spark, sf_dir):
    back = spectral.istft(spectral.stft(emb(spark, sf_dir), N, HOP), N, HOP)
    return back.select("clip_id", "n", (r6("x") + 0.0).alias("x"))


@query(f"""with {U_S}, l as (select clip_id, count(*) as len from s group by 1), w as (select s.clip_id, t, n - t as i, x * (0.5 - 0.5 * cos(2 * pi() * (n - t) / 32)) as x from s join l using (clip_id) join (select unnest(range(0, 80, 4)) as t) on n between t and t + 31 and t + 32 <= len)
select a.clip_id, cast(a.t // 4 as integer) as t, cast(b.i - a.i as integer) as lag, round(sum(a.x * b.x / (32 - (b.i - a.i))), 4) as value from w a join w b on a.clip_id = b.clip_id and a.t = b.t and b.i - a.i between 2 and 20 group by a.clip_id, a.t, b.i - a.i""")
def tempogram(spark, sf_dir):
    rows = temporal.tempogram(samples(spark, sf_dir), 32, 4, fps=1.0, bpm=(3.0, 30.0))
    return rows.select("clip_id", "t", F.col("lag").cast("int").alias("lag"), F.round("value", 4).alias("value"))


MEL = spectral.mel_weights(6, N, SR, style="htk")


def _mel_sql() -> str:
    rows = ", ".join(f"({m}, {k}, {float(MEL[m, k])!r})" for m, k in zip(*np.nonzero(MEL), strict=True))
    return f"with {E_C}, w(m, k, w) as (values {rows}) select clip_id, cast(t as integer) as t, cast(m as integer) as m, round(sum((re * re + im * im) * cast(w as double)), 6) as value from c join w using (k) group by all"


@query(_mel_sql())
def mel_join(spark, sf_dir):
    power = spectral.power_frames(emb(spark, sf_dir), N, HOP, center=False)
    return tall_rounded(spectral.apply_filterbank_join(power, MEL), "value")


@query()
def mfcc_events(spark, sf_dir):
    return points(spectral.mfcc(samples(spark, sf_dir), SR, N, HOP, 12, 6, lifter=8), "v", "clip_id", "t", name="c")


@query()
def chroma_and_tonnetz(spark, sf_dir):
    return points(spectral.tonnetz(spectral.chroma(emb(spark, sf_dir), 8000, N, HOP, norm="l1")), "v", "clip_id", "t", name="c")


@query()
def constant_q(spark, sf_dir):
    return points(spectral.magnitude(spectral.cqt(emb(spark, sf_dir), SR, 8, 8.0, 12)), "v", "clip_id", "t", name="k")


@query()
def hpss_masks(spark, sf_dir):
    m = decompose.hpss(magnitudes(spark, sf_dir), 7, 5)
    return m.select("clip_id", "t", "f", r6("harmonic").alias("harmonic"), r6("percussive").alias("percussive"))


@query()
def pitch_track(spark, sf_dir):
    p = pitch.pitches(samples(spark, sf_dir), SR, 32, 8, 4.0, 20.0)
    return p.select("clip_id", "t", r6("pitch").alias("pitch"), r6("confidence").alias("confidence"))


@query()
def onsets(spark, sf_dir):
    return chains.onsets(samples(spark, sf_dir), SR, N, HOP, 8).withColumn("time_s", r6("time_s"))


@query()
def split_silence(spark, sf_dir):
    clips = samples(spark, sf_dir)
    return events.split_silence(frames.frame(clips, 8, 4), clips.groupBy("clip_id").agg((F.max("n") + 1).alias("n_samples")), 8, 4, 6.0)


@query()
def alignment(spark, sf_dir):
    rows = emb(spark, sf_dir).withColumn("f", F.expr("transform(y, z -> array(z))"))
    pairs = rows.where("clip_id % 2 = 0").alias("a").join(rows.alias("b"), F.expr("b.clip_id = a.clip_id + 1")).select(F.col("a.clip_id").alias("pair_id"), F.col("a.f").alias("x"), F.col("b.f").alias("y"))
    return warping.align(pairs).select("pair_id", r6("cost").alias("cost"), F.size("path").alias("steps"))


@query()
def recurrence_statistics(spark, sf_dir):
    rows = labelled_frames(spark, sf_dir)
    sizes = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"))
    s = similarity.recurrence_statistics(similarity.recurrence(rows, width=8, k=3), sizes)
    return s.select("clip_id", *(r6(c).alias(c) for c in ("rr", "det", "l", "lam", "tt")))


@query()
def gru_outputs(spark, sf_dir):
    rows = emb(spark, sf_dir).select(F.col("clip_id").alias("seq_id"), F.expr("transform(sequence(0, 7), i -> slice(y, i * 8 + 1, 8))").alias("x"))
    w = [recurrent.random_weights("gru", 8, 4, s) for s in (42, 43)]
    return points(recurrent.run_layers(rows, [w], "gru").withColumn("z", F.flatten("out")), "z", "seq_id")


@query(f"with {U_S} select clip_id, cast(n as bigint) as n, round(x, 6) as x from s")
def cross_fade_round_trip(spark, sf_dir):
    parts = rates.chunks(samples(spark, sf_dir), 16)
    return tall_rounded(rates.cross_fade(parts, 16)).withColumn("n", F.col("n").cast("long"))


@query(f"""with {E_S}, h as (select unnest(range(5)) as k, unnest([{", ".join(repr(float(v)) for v in rates.low_pass(5, 0.2))}]) as w) select a.clip_id, cast(a.n as integer) as i, round(sum(cast(w as double) * coalesce(b.x, 0)), 6) + 0.0 as x from s a cross join h left join s b on b.clip_id = a.clip_id and b.n = a.n + k - 2 group by a.clip_id, a.n""")
def low_pass(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", rates.convolve("y", rates.low_pass(5, 0.2))), "z", "clip_id").withColumn("x", F.col("x") + 0.0)


@query()
def separated_sources(spark, sf_dir):
    spectra = spectral.stft(emb(spark, sf_dir), N, HOP)
    masks = spectra.select("clip_id", "t", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("source"), "re")
    mre = F.expr("transform(re, (x, k) -> case when (k < 4) = (source = 'low') then 1D else 0D end)")
    return tall_rounded(rates.separate_by_masks(spectra, masks.select("clip_id", "t", "source", mre.alias("mre"), F.expr("transform(re, x -> 0D)").alias("mim")), N, HOP))


@query(f"""with {U_S}, l as (select clip_id, count(*) as len from s group by 1) select clip_id, cast(t as integer) as t, cast(n - t * 8 as integer) as i, round(x, 6) as x from s join l using (clip_id) join (select unnest(range(40)) as t) on n between t * 8 and t * 8 + 15 and t * 8 + 16 <= len""")
def streamed_frames(spark, sf_dir):
    """Frames cut from a stream of the users' samples, a chunk a row."""
    from wavemill.operators.frames import chunk_rows
    from wavemill.streaming.state import run_available, stream_frames

    rows = chunk_rows(samples(spark, sf_dir), 10)
    return points(run_available(rows, lambda s: stream_frames(s, 16, 8, pad_end=False)), "v", "clip_id", "t")


@query(f"with {E_S} select clip_id, cast(n as integer) as i, round(x, 6) as x from s")
def interleave_round_trip(spark, sf_dir):
    rows = emb(spark, sf_dir).withColumn("channels", F.expr("array(y, transform(y, x -> -x))")).withColumn("mixed", frames.interleave())
    return points(rows.withColumn("back", frames.deinterleave("mixed", 2)).withColumn("z", F.col("back")[0]), "z", "clip_id")


@query(f"with {E_S}, g as (select clip_id, n, x < -1e-10 as neg from s), d as (select clip_id, n, neg <> lag(neg) over (partition by clip_id order by n) as c from g) select clip_id, cast(n as integer) as place from d where c")
def zero_crossings(spark, sf_dir):
    return emb(spark, sf_dir).select("clip_id", F.explode(features.crossings("y")).alias("place"))


@query(f"with {E_S} select a.clip_id, cast(b.n - a.n as integer) as lag, round(sum(a.x * b.x), 5) + 0.0 as x from s a join s b on a.clip_id = b.clip_id and b.n - a.n between 0 and 15 group by a.clip_id, b.n - a.n")
def autocorrelation(spark, sf_dir):
    rows = emb(spark, sf_dir).withColumn("z", temporal.autocorrelation("y", 16)).select("clip_id", F.posexplode("z").alias("lag", "x"))
    return rows.withColumn("x", F.round("x", 5) + 0.0)


@query("""with q as (select p_partkey, p_retailprice as f, p_retailprice * p_retailprice as q from part)
select p_partkey, round(20 * log10(sqrt(q / ((q + 79919.29) * (q + 1345600.0)) * (pow(1037918.48 - q, 2) + 1080768.16 * q) / (pow(9837328.0 - q, 2) + 11723776.0 * q)) * 1000), 6) as d,
round(20 * log10(1.246332637532143e-4 * f / sqrt(pow(-4.737338981378384e-24 * q * q * q + 2.043828333606125e-15 * q * q - 1.363894795463638e-7 * q + 1, 2) + pow(1.306612257412824e-19 * q * q * f - 2.118150887518656e-11 * q * f + 5.559488023498642e-4 * f, 2))) + 18.2, 6) as itu468 from q""")
def weighting_curves_more(spark, sf_dir):
    f = F.col("p_retailprice")
    return read(spark, sf_dir, "part").select("p_partkey", *(r6(units.weighting(f, c)).alias(c) for c in ("d", "itu468")))


@query(f"with {E_M}, b as (select clip_id, t, k, greatest(0, v - lag(v) over (partition by clip_id, k order by t)) as r from m) {FS} cast(case when k < 3 then 0 when k < 6 then 1 else 2 end as integer) as band, round(coalesce(avg(r), 0), 6) as strength from b group by all")
def onset_strength_bands(spark, sf_dir):
    return events.multiband_onset(magnitudes(spark, sf_dir), N // 2 + 1, 3).withColumn("strength", r6("strength"))


@query(f"with {U_S} select clip_id, cast(n as integer) as i, round(case when n = 0 then 0 else greatest(0, x - lag(x) over (partition by clip_id order by n)) end, 6) as x from s")
def rises(spark, sf_dir):
    return tall_rounded(temporal.rises_tall(samples(spark, sf_dir))).withColumn("n", F.col("n").cast("int")).withColumnRenamed("n", "i")


@query(f"with {E_M}, d as (select clip_id, t, k, v, lag(v) over (partition by clip_id, k order by t) as p from m) {FS} round(corr(v, p), 5) + 0.0 as r from d where t > 0 group by all")
def frame_correlation(spark, sf_dir):
    from pyspark.sql import Window

    rows = magnitudes(spark, sf_dir).withColumn("p", F.lag("v").over(Window.partitionBy("clip_id").orderBy("t"))).where("p is not null")
    return rows.select("clip_id", "t", (F.round(features.correlation("v", "p"), 5) + 0.0).alias("r"))


@query()
def onset_strength_complex(spark, sf_dir):
    return events.complex_onset(spectral.stft(emb(spark, sf_dir), N, HOP, center=False)).withColumn("strength", r6("strength"))


@query()
def local_pulse(spark, sf_dir):
    return points(users(spark, sf_dir).withColumn("z", temporal.local_pulse("y", 2, 12)), "z", "clip_id")


@query()
def tempo(spark, sf_dir):
    return temporal.tempo(users(spark, sf_dir), 8.0).withColumn("bpm", r6("bpm"))


@query()
def chroma_statistics(spark, sf_dir):
    return points(spectral.cens(spectral.chroma(emb(spark, sf_dir), 8000, N, HOP), 5), "v", "clip_id", "t", name="c")


@query()
def repeating_parts(spark, sf_dir):
    parts = similarity.decompose(similarity.soft_mask(labelled_frames(spark, sf_dir), 5, 3, "euclidean"))
    return parts.select("clip_id", "t", "f", r6("repeating").alias("repeating"), r6("other").alias("other"))


@query()
def subsequence_alignment(spark, sf_dir):
    rows = emb(spark, sf_dir).withColumn("f", F.expr("transform(y, z -> array(z))"))
    pairs = rows.select(F.col("clip_id").alias("pair_id"), F.expr("slice(f, 21, 12)").alias("x"), F.col("f").alias("y"))
    found = warping.align(pairs, subsequence=True)
    return found.select("pair_id", r6("cost").alias("cost"), F.col("path")[0]["j"].alias("start"))


