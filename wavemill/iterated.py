"""Queries of iterative and recurrent operators with SQL that gives the same rows: recursive tables, one step of the operator each.

First phases and first factors are those that SQL can write down.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import alignment as warping
from wavemill.operators import decompose, spectral, temporal
from wavemill.queries import E_M, E_S, HOP, N, SR, U_S, emb, magnitudes, points, r6, samples, tall_users
from wavemill.wider import centred, values

QUERIES: dict = {}
#: SQL by query, of this module and of the first one.
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(make):
        QUERIES[make.__name__] = make
        ORACLE_SQL[make.__name__] = sql
        return make

    return keep


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


# A frame's spectrum to samples and back, as weights: of the samples n of a signal of FRAMES centred frames.
FIXED = f"""kk as (select unnest(range({N // 2 + 1})) as k), ii as (select unnest(range({N})) as i)"""


def both_ways(frames: int) -> str:
    """sy(n, t, k, cr, ci) and an(t, k, n, ar, ai): overlap-add of inverse frames, and forward frames of the signal."""
    half, length = N // 2, (frames - 1) * HOP
    hann = f"(0.5 - 0.5 * cos(2 * pi() * i / {N}))"
    return f"""{FIXED}, places as (select t, i, t * {HOP} - {half} + i as n, {hann} as w from (select unnest(range({frames})) as t) cross join ii),
weights as (select n, greatest(sum(w * w), 1e-10) as ww from places group by n),
sy as materialized (select n, t, k, w / ww * (case when k in (0, {half}) then 1 else 2 end) * cos(2 * pi() * k * i / {N}) / {N} as cr,
    -w / ww * (case when k in (0, {half}) then 0 else 2 end) * sin(2 * pi() * k * i / {N}) / {N} as ci from places join weights using (n) cross join kk where n between 0 and {length - 1}),
an as materialized (select t, k, n, w * cos(2 * pi() * k * i / {N}) as ar, -w * sin(2 * pi() * k * i / {N}) as ai from places cross join kk where n between 0 and {length - 1})"""


PHASE = "(clip_id * 7919 + t * 104729 + {i} * 1299709) % 1000003 / 1000003.0 * 2 * pi()"
A = 0.99 / 1.99


@query(f"""with recursive {E_M.removesuffix(", k * " + str(SR / N) + " as f from c)")}, cast({PHASE.format(i="k")} as double) as a from c), {both_ways(13)},
g as (
    select 0 as it, clip_id, t, k, v, v * cos(a) as re, v * sin(a) as im, 0.0::double as r0, 0.0::double as i0 from m
    union all
    select it + 1, clip_id, t, k, v, case when q > 0 then v * tr / q else v end, case when q > 0 then v * ti / q else 0 end, r1, i1 from (
        select *, sqrt(tr * tr + ti * ti) as q from (select g.it, g.clip_id, g.t, g.k, g.v, r1, i1, case when g.it = 0 then r1 else r1 - {A!r} * g.r0 end as tr, case when g.it = 0 then i1 else i1 - {A!r} * g.i0 end as ti
            from g join (select clip_id, t, k, sum(ar * x) as r1, sum(ai * x) as i1 from (select clip_id, n, sum(cr * re + ci * im) as x from g join sy using (t, k) group by clip_id, n) x join an using (n) group by clip_id, t, k) made using (clip_id, t, k)
            where g.it < 32)))
, e as (select clip_id, it, sum(pow(sqrt(r0 * r0 + i0 * i0) - v, 2)) as e from g where it > 0 group by all),
best as (select clip_id, arg_min(it, e) as it from e group by clip_id)
select clip_id, cast(n as bigint) as n, round(sum(cr * re + ci * im), 3) + 0.0 as x from g join best using (clip_id, it) join sy using (t, k) group by clip_id, n""")
def griffin_lim(spark, sf_dir):
    return rounded(spectral.griffin_lim(magnitudes(spark, sf_dir), N, HOP, angle=PHASE.format(i="i")), 3, "x")


@query(f"""with {centred(E_S)}, {both_ways(14)}, p as (select clip_id, t, k, sqrt(re * re + im * im) as m, atan2(im, re) as p from c), us as (select unnest(range(14)) as u),
b as (select a.clip_id, u, a.k, a.m + (u * 1.25 - a.t) * (b.m - a.m) as mag, a.p as p1, b.p - a.p - a.k * (2 * pi() * {HOP} / {N}) as d from us join p a on a.t = least(16, cast(floor(u * 1.25) as int)) join p b on b.clip_id = a.clip_id and b.k = a.k and b.t = least(16, a.t + 1)),
s as (select *, k * (2 * pi() * {HOP} / {N}) + d - 2 * pi() * round(d / (2 * pi())) as step from b),
z as (select clip_id, u as t, k, mag, first_value(p1) over w + coalesce(sum(step) over (partition by clip_id, k order by u rows between unbounded preceding and 1 preceding), 0) as a from s window w as (partition by clip_id, k order by u))
select clip_id, cast(n as bigint) as n, round(sum(cr * mag * cos(a) + ci * mag * sin(a)), 6) + 0.0 as x from z join sy using (t, k) group by clip_id, n""".replace("s as (select *, k", "st as (select *, k").replace("as a from s window", "as a from st window"))
def time_stretch(spark, sf_dir):
    return rounded(spectral.time_stretch(emb(spark, sf_dir), 1.25, N, HOP), 6, "x")


B0 = decompose.first_basis(N // 2 + 1, 3)


def _factors(last: str) -> str:
    """Rounds of updates: rows h (frame, k), w (bin, k) and one of the error, which ends them when it hardly changes."""
    return f"""with recursive {E_M}, {values("w0", B0, "k, f, w")}, x as materialized (select clip_id, t, cast(k as int) as f, v as x from m),
st as (
    select 0 as n, 'h' as kind, clip_id, t, k, -1 as f, avg(x) / {float(B0.mean()) * 3!r} as v, false as done from x cross join (select unnest(range(3)) as k) group by clip_id, t, k
    union all select 0, 'w', -1, -1, k, f, w, false from w0 union all select 0, 'e', -1, -1, -1, -1, 'Infinity'::double, false
    union all
    (with h as (select n, clip_id, t, k, v from st where kind = 'h' and not done and n < 200), w as (select k, f, v from st where kind = 'w'), o as (select v from st where kind = 'e'),
    g as (select a.k, b.k as j, sum(a.v * b.v) as g from w a join w b using (f) group by all),
    up as (select clip_id, t, w.k, sum(w.v * x) as u from x join w using (f) group by all),
    dn as (select clip_id, t, g.k, sum(g.g * h.v) as d from h join g on g.j = h.k group by all),
    h2 as (select n + 1 as n, clip_id, t, k, greatest(1e-10, v * u / (d + 1e-10)) as v from h join up using (clip_id, t, k) join dn using (clip_id, t, k)),
    num as (select k, f, sum(v * x) as u from h2 join x using (clip_id, t) group by all),
    gr as (select a.k, b.k as j, sum(a.v * b.v) as g from h2 a join h2 b using (clip_id, t) group by all),
    dw as (select gr.k, f, sum(gr.g * w.v) as d from gr join w on w.k = gr.j group by all),
    w2 as (select w.k, w.f, greatest(1e-10, w.v * u / (d + 1e-10)) as v from w join num using (k, f) join dw using (k, f)),
    e2 as (select sqrt(sum(pow(x.x - y, 2))) as e from x join (select clip_id, t, w2.f, sum(h2.v * w2.v) as y from h2 join w2 using (k) group by all) using (clip_id, t, f)),
    dd as (select e, o.v < 'Infinity'::double and abs(o.v - e) / (o.v + 1e-10) < 1e-4 as done from e2, o)
    select h2.n, 'h', clip_id, t, k, -1, h2.v, done from h2, dd union all select (select max(n) from h2), 'w', -1, -1, k, f, w2.v, done from w2, dd where (select count(*) from h2) > 0
    union all select (select max(n) from h2), 'e', -1, -1, -1, -1, e, done from dd where (select count(*) from h2) > 0)
) {last}"""


@query(_factors("select clip_id, cast(t as integer) as t, cast(k as integer) as k, round(v, 6) + 0.0 as x from st where kind = 'h' and n = (select max(n) from st)"))
def nmf_activations(spark, sf_dir):
    found = decompose.nmf(magnitudes(spark, sf_dir), N // 2 + 1, 3)
    return points(found.activations, "v", "clip_id", "t", name="k")


@query(_factors("select cast(n as integer) as round, round(v, 4) as error from st where kind = 'e' and n > 0"))
def nmf_errors(spark, sf_dir):
    """What is left after every round of the factors of all frames, until it hardly changes."""
    found = decompose.nmf(magnitudes(spark, sf_dir), N // 2 + 1, 3)
    return spark.createDataFrame([(k + 1, e) for k, e in enumerate(found.errors)], "round int, error double").withColumn("error", F.round("error", 4))


def _warped(pairs: str, n: int, m: int, ok: str = "true", subsequence: bool = False) -> str:
    """Anti-diagonal after anti-diagonal: cur and the one before it by i, with the number of steps and the start of the best path."""
    first = f"case when i = 0 and {ok.replace('s - i', '0')} then abs(xs[1] - ys[1]) else 'Infinity'::double end"
    up, left, diag = "lag(cur) over o", "cur", "lag(prev) over o"
    inf = "'Infinity'::double"
    start = "s - i" if subsequence else "0"
    top = f"when i = 0 and {'true' if subsequence else 'false'} then abs(xs[1] - ys[s + 1])"
    return f"""with recursive {E_S}, p as materialized ({pairs}), w as (
    select 0 as s, pair_id, i, {first} as cur, {inf} as prev, 1 as st, 1 as st1, 0 as b, 0 as b1 from p cross join (select unnest(range({n})) as i)
    union all
    select s, pair_id, i, case when s - i not between 0 and {m - 1} or not ({ok}) then {inf} {top} else abs(xs[i + 1] - ys[s - i + 1]) + least(d, u, l) end, l,
        case when i = 0 and {'true' if subsequence else 'false'} then 1 when d <= u and d <= l then sd + 1 when u <= l then su + 1 else sl + 1 end, sl,
        case when i = 0 then {start} when d <= u and d <= l then bd when u <= l then bu else bl end, bl
    from (select s + 1 as s, pair_id, i, coalesce({up}, {inf}) as u, {left} as l, coalesce({diag}, {inf}) as d, lag(st) over o as su, st as sl, lag(st1) over o as sd, lag(b) over o as bu, b as bl, lag(b1) over o as bd
        from w where s < {n + m - 2} window o as (partition by pair_id order by i)) z join p using (pair_id)
)"""


TWO = "select a.clip_id as pair_id, a.l as xs, b.l as ys from (select clip_id, list(x order by n) as l from s group by 1) a join (select clip_id, list(x order by n) as l from s group by 1) b on b.clip_id = a.clip_id + 1 where a.clip_id % 2 = 0"
ONE = "select clip_id as pair_id, list(x order by n) filter (n between 20 and 31) as xs, list(x order by n) as ys from s group by 1"
ORACLE_SQL["alignment"] = f"{_warped(TWO, 64, 64)} select pair_id, round(cur, 6) + 0.0 as cost, cast(st as integer) as steps from w where s = 126 and i = 63"
ORACLE_SQL["subsequence_alignment"] = f"{_warped(ONE, 12, 64, subsequence=True)} select pair_id, round(min(cur), 6) + 0.0 as cost, cast(arg_min(b, (cur, s)) as integer) as start from w where i = 11 and s between 11 and 74 group by pair_id"

BAND_OK, SLOPE_OK = "abs((s - i) - i) <= 6", "(i = 0 or (s - i) / i::double between 0.5 and 2) and (i = 63 or (63 - (s - i)) / (63 - i)::double between 0.5 and 2) or (i = 0 and s = 0) or (i = 63 and s = 126)"


def neighbours(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every other embedding and the one behind it, as sequences of single values."""
    rows = emb(spark, sf_dir).select("clip_id", F.posexplode("y").alias("t", "x")).select("clip_id", "t", F.array("x").alias("v"))
    return rows.where("clip_id % 2 = 0").withColumnRenamed("clip_id", "pair_id"), rows.where("clip_id % 2 = 1").select((F.col("clip_id") - 1).alias("pair_id"), "t", "v")


def by_tiles(spark, sf_dir, window: str | None, param: int | None) -> DataFrame:
    costs, _ = warping.align_tall(*neighbours(spark, sf_dir), window=window, param=param, tile=32)
    return costs.select("pair_id", r6("cost").alias("cost"), F.col("steps").cast("int").alias("steps"))


@query(f"{_warped(TWO, 64, 64, BAND_OK)} select pair_id, round(cur, 6) + 0.0 as cost, cast(st as integer) as steps from w where s = 126 and i = 63")
def alignment_in_band(spark, sf_dir):
    """By tiles of 32, so that borders are passed on."""
    return by_tiles(spark, sf_dir, "band", 6)


@query(f"{_warped(TWO, 64, 64, SLOPE_OK)} select pair_id, round(cur, 6) + 0.0 as cost, cast(st as integer) as steps from w where s = 126 and i = 63")
def alignment_in_parallelogram(spark, sf_dir):
    return by_tiles(spark, sf_dir, "itakura", 2)


@query(f"with {U_S} select clip_id, cast(n as bigint) as n, round(x, 6) + 0.0 as x from s")
def emphasis_of_tall_samples(spark, sf_dir):
    """There and back over samples of any length, by blocks."""
    there = temporal.preemphasis_tall(samples(spark, sf_dir))
    return rounded(temporal.deemphasis_tall(there), 6, "x")


@query(f"""with {U_S}, m as (select a.clip_id, a.n, any_value(a.x) as x, sum(0.2 * pow(0.8, a.n - b.n) * b.x) + any_value(pow(0.8, a.n + 1)) as m from s a join s b on a.clip_id = b.clip_id and b.n <= a.n group by a.clip_id, a.n)
select clip_id, cast(n as integer) as t, round(sqrt(2) * (exp(0.5 * ln(1 + x * exp(-0.98 * (ln(1e-6) + ln(1 + m / 1e-6))) / 2)) - 1), 6) as x from m where n >= 20""")
def pcen_continued(spark, sf_dir):
    """The past of each track's first twenty samples is handed on to the rest of it."""
    values_ = tall_users(spark, sf_dir)
    state = temporal.pcen_state(values_.where("t < 20"), b=0.2)
    return temporal.pcen(values_.where("t >= 20"), b=0.2, initial=state).select("clip_id", F.col("t").cast("int").alias("t"), r6("y").alias("x"))


@query(f"""with recursive {E_M}, {values("w", B0, "k, f, w")}, x as materialized (select clip_id, t, cast(k as int) as f, v as x from m), up as materialized (select clip_id, t, w.k, sum(w.w * x) as u from x join w using (f) group by all),
g as materialized (select a.k, b.k as j, sum(a.w * b.w) as g from w a join w b using (f) group by all),
h as (select 0 as n, clip_id, t, k, 1.0::double as v from up union all
    select n + 1, clip_id, t, k, v * u / greatest(d, 1e-10) from h join up using (clip_id, t, k) join (select clip_id, t, g.k, sum(g.g * h.v) as d from h join g on g.j = h.k group by all) dn using (clip_id, t, k) where n < 100)
select clip_id, cast(t as integer) as t, cast(w.f as integer) as f, round(sum(h.v * w.w), 6) + 0.0 as x from h join w using (k) where n = 100 group by clip_id, t, w.f""")
def nmf_rebuilt(spark, sf_dir):
    """Frames put together again from activations of a given basis."""
    act = decompose.nmf_transform(magnitudes(spark, sf_dir), B0)
    return rounded(points(decompose.nmf_reconstruct(act, B0), "v", "clip_id", "t", name="f"), 6, "x")
