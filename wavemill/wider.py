"""More queries over the test tables with SQL that gives the same rows, and SQL for queries of the first module.

Filters and kernels stand in the SQL as rows of VALUES; recurrences are recursive or joins with powers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import arrays, units
from wavemill.operators import augment, events, features, frames, recurrent, similarity, spectral, temporal
from wavemill.queries import BAND, E_C, E_M, E_S, HOP, N, SR, U_S, emb, labelled_frames, magnitudes, points, r6, read, samples, tall_rounded

QUERIES: dict = {}
#: SQL by query, of this module and of the first one.
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(make):
        QUERIES[make.__name__] = make
        ORACLE_SQL[make.__name__] = sql
        return make

    return keep


def values(name: str, m: np.ndarray, columns: str = "m, k, w") -> str:
    """A matrix as a table of row, column and value, zeros too."""
    rows = ", ".join(f"({a}, {b}, {float(m[a, b])!r}::double)" for a in range(m.shape[0]) for b in range(m.shape[1]))
    return f"{name}({columns}) as (values {rows})"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


HANN = f"(0.5 - 0.5 * cos(2 * pi() * i / {N}))"
K = f"(select unnest(range({N // 2 + 1})) as k)"
LEN = "l as (select clip_id, count(*) as len from s group by 1)"


def centred(source: str, mode: str = "zeros", name: str = "c") -> str:
    """Spectra of frames centred on multiples of the hop, over zeros or the reflected signal."""
    half = N // 2
    pad = "" if mode == "zeros" else f"""
union all select s.clip_id, -p, x from s join l using (clip_id) join (select unnest(range(1, {half + 1})) as p) on s.n = p % len
union all select s.clip_id, len - 1 + p, x from s join l using (clip_id) join (select unnest(range(1, {half + 1})) as p) on s.n = len - 1 - p % len"""
    return f"""{source}, {LEN}, pd as (select clip_id, n, x from s {pad}),
ts as (select clip_id, unnest(range(len // {HOP} + 1)) as t from l),
cf as (select ts.clip_id, ts.t, pd.n + {half} - ts.t * {HOP} as i, x from ts join pd on pd.clip_id = ts.clip_id and pd.n between ts.t * {HOP} - {half} and ts.t * {HOP} + {half - 1}),
{name} as (select clip_id, t, k, sum(x * {HANN} * cos(2 * pi() * k * i / {N})) as re, -sum(x * {HANN} * sin(2 * pi() * k * i / {N})) as im from cf cross join {K} group by clip_id, t, k)"""


def log_mel(source: str, n_mels: int, mode: str = "zeros") -> str:
    return f"""{centred(source, mode)}, {values("mw", spectral.mel_weights(n_mels, N, SR))},
me as (select clip_id, t, m, 10 * log10(greatest(sum((re * re + im * im) * w), 1e-10)) as v from c join mw using (k) group by all),
db as (select clip_id, t, m, greatest(v, max(v) over (partition by clip_id) - 80) as v from me)"""


def _cepstrum() -> np.ndarray:
    return spectral.dct_matrix(6, 12) * (1 + 4 * np.sin(np.pi * np.arange(1, 7) / 8))[:, None]


ORACLE_SQL["mfcc_events"] = f"with {log_mel(U_S, 12)}, {values('d', _cepstrum(), 'c, m, w')} select clip_id, cast(t as integer) as t, cast(c as integer) as c, {r('sum(v * w)')} as x from db join d using (m) group by all"

_CHROMA = f"{centred(E_S)}, {values('cw', spectral.chroma_weights(N, 8000))}, ch as (select clip_id, t, m, sum((re * re + im * im) * w) as v from c join cw using (k) group by all)"


def _fifths() -> np.ndarray:
    a, size = (7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3), (1, 1, 1, 1, 0.5, 0.5)
    return np.stack([size[k] * (np.sin if k % 2 == 0 else np.cos)(np.pi * np.arange(12) * a[k]) for k in range(6)])


ORACLE_SQL["chroma_and_tonnetz"] = f"""with {_CHROMA}, {values("tw", _fifths(), "c, m, w")}, u as (select *, sum(abs(v)) over (partition by clip_id, t) as s from ch)
select clip_id, cast(t as integer) as t, cast(c as integer) as c, {r("sum(case when s > 1e-10 then v / s else v end * w)")} as x from u join tw using (m) group by all"""

ORACLE_SQL["chroma_statistics"] = f"""with {_CHROMA}, n2 as (select *, sqrt(sum(v * v) over (partition by clip_id, t)) as q from ch), n1 as (select clip_id, t, m, case when q > 1e-10 then v / q else v end as v from n2),
u as (select *, sum(abs(v)) over (partition by clip_id, t) as s from n1), z as (select clip_id, t, m, case when s > 1e-10 then v / s else 0 end as v from u),
qz as (select clip_id, t, m, ((v > 0.4)::int + (v > 0.2)::int + (v > 0.1)::int + (v > 0.05)::int) / 4.0 as v from z),
sm as (select a.clip_id, a.t, a.m, sum(b.v * (0.5 - 0.5 * cos(2 * pi() * (a.t - b.t + 3) / 6))) / sum(0.5 - 0.5 * cos(2 * pi() * (a.t - b.t + 3) / 6)) as v from qz a join qz b on a.clip_id = b.clip_id and a.m = b.m and abs(a.t - b.t) <= 2 group by all),
f as (select *, sqrt(sum(v * v) over (partition by clip_id, t)) as q from sm) select clip_id, cast(t as integer) as t, cast(m as integer) as c, {r("case when q > 1e-10 then v / q else 0 end")} as x from f"""


def _constant_q() -> str:
    freqs = 8.0 * 2.0 ** (np.arange(12) / 12)
    q = 1 / (2 ** (1 / 12) - 1)
    size = int(np.ceil(SR / (8.0 / q)))
    bank = spectral.kernels(freqs, SR, size, q)
    keep = [(k, i) for k in range(12) for i in range(size) if bank[k, i] != 0]
    rows = ", ".join(f"({k}, {i - size // 2}, {float(bank[k, i].real)!r}::double, {float(bank[k, i].imag)!r}::double)" for k, i in keep)
    return f"""with {E_S}, b(k, i, br, bi) as (values {rows}), ts as (select unnest(range({(64 + 2 * (size // 2) - size) // 8 + 1})) as t)
select clip_id, cast(t as integer) as t, cast(k as integer) as k, {r("sqrt(pow(sum(x * br), 2) + pow(sum(x * bi), 2))")} as x from ts cross join b join s on s.n = t * 8 + b.i group by clip_id, t, k"""


ORACLE_SQL["constant_q"] = _constant_q()

ORACLE_SQL["hpss_masks"] = f"""with {E_M}, w as (select clip_id, t, k, list_sort(list(v) over (partition by clip_id, k order by t rows between 3 preceding and 3 following)) as a, list_sort(list(v) over (partition by clip_id, t order by k rows between 2 preceding and 2 following)) as b from m),
h as (select clip_id, t, k, pow(a[len(a) // 2 + 1], 2) as h, pow(b[len(b) // 2 + 1], 2) as p from w) select clip_id, cast(t as integer) as t, cast(k as integer) as f, {r("h / (h + p + 1e-10)")} as harmonic, {r("p / (h + p + 1e-10)")} as percussive from h"""

_ENVELOPE = f"{log_mel(U_S, 8, 'reflect')}, dv as (select clip_id, t, v - lag(v) over (partition by clip_id, m order by t) as d from db), env as (select clip_id, t, coalesce(sum(greatest(d, 0)), 0) / 8 as x from dv group by all)"

ORACLE_SQL["onsets"] = f"""with {_ENVELOPE}, e0 as (select *, min(x) over (partition by clip_id) as lo, max(x) over (partition by clip_id) as hi, count(*) over (partition by clip_id) as n from env),
e as (select clip_id, t, n, case when hi - lo > 1e-6 then (x - lo) / (hi - lo) else 0 end as e from e0 where hi > 1e-6),
w as (select *, lag(e) over v as a, lead(e) over v as b, avg(e) over (partition by clip_id order by t rows between 3 preceding and 3 following) as m from e window v as (partition by clip_id order by t))
select clip_id, cast(t as integer) as t, {r(f"t * {HOP} / {SR}")} as time_s from w where n > 2 and t between 1 and n - 2 and greatest(a, b) < e and e >= m + 0.07 and e >= 0"""

ORACLE_SQL["tempo"] = f"""with {U_S}, {LEN}, a as (select a.clip_id, b.n - a.n as lag, sum(a.x * b.x) as v from s a join s b on a.clip_id = b.clip_id and b.n >= a.n and b.n - a.n < 384 group by all),
n as (select clip_id, lag, v / greatest(first_value(v) over (partition by clip_id order by lag), 1e-10) as v from a), sc as (select *, ln(1 + 1e6 * greatest(v, 0)) - 0.5 * pow(log2(480.0 / lag) - log2(120), 2) as score from n where lag > 0),
b as (select clip_id, lag, v from (select *, row_number() over (partition by clip_id order by score desc, lag) as k from sc) where k = 1), top as (select clip_id, max(x) as top from s group by 1)
select clip_id, {r("case when top < 1e-10 or v < 0.01 then 0 else 480.0 / lag end")} as bpm from b join top using (clip_id) join l using (clip_id) where len > 1"""


def yin(reflect: bool) -> str:
    """Pitch and confidence of frames of 32 at hops of 8 between 4 and 20 Hz."""
    pad = 16 if reflect else 0
    edge = """union all select s.clip_id, -p, x from s join l using (clip_id) join (select unnest(range(1, 17)) as p) on s.n = p
union all select s.clip_id, len - 1 + p, x from s join l using (clip_id) join (select unnest(range(1, 17)) as p) on s.n = len - 1 - p""" if reflect else ""
    return f"""{U_S}, {LEN}, pd as (select clip_id, n + {pad} as n, x from (select clip_id, n, x from s {edge})),
ts as (select clip_id, unnest(range((len + {2 * pad} - 32) // 8 + 1)) as t from l where len >= 32),
df as (select ts.clip_id, ts.t, b.n - a.n as lag, sum(pow(a.x - b.x, 2)) as d from ts join pd a on a.clip_id = ts.clip_id and a.n between ts.t * 8 and ts.t * 8 + 14 join pd b on b.clip_id = a.clip_id and b.n - a.n between 0 and 16 group by all),
nm as (select clip_id, t, lag, case when lag = 0 then 1 when c > 0 then d * lag / c else 1 end as d from (select *, sum(case when lag > 0 then d else 0 end) over (partition by clip_id, t order by lag) as c from df)),
w as (select *, lag(d) over v as a, lead(d) over v as c from nm window v as (partition by clip_id, t order by lag)),
pick as (select clip_id, t, coalesce(min(lag) filter (lag >= 3 and lag < 16 and d < 0.1 and d <= c and d <= a), case when min(d) filter (lag >= 3) < 0.5 then arg_min(lag, d * 1.0 + lag * 0.0) filter (lag >= 3) end) as lag from w group by all),
f as (select p.clip_id, p.t, w.d, {SR} / (p.lag + case when p.lag < 16 and abs(a - 2 * d + c) > 1e-10 then 0.5 * (a - c) / (a - 2 * d + c) else 0 end) as f from pick p left join w on w.clip_id = p.clip_id and w.t = p.t and w.lag = p.lag)
select clip_id, cast(t as integer) as t, {r("case when f between 4 and 20 then f else 0 end")} as pitch, {r("case when f between 4 and 20 then 1 - d else 0 end")} as confidence from f"""


ORACLE_SQL["pitch_track"] = f"with {yin(True)}"

ORACLE_SQL["recurrence_statistics"] = f"""with {BAND.replace("<= 5", "<= 8")}, rk as (select *, row_number() over (partition by clip_id, i order by dist, j) as rank from p), nn as (select clip_id, i, j from rk where rank <= 3),
ln as (select distinct clip_id, i, j from (select * from nn union all select clip_id, j, i from nn)),
dd as (select clip_id, key, gg, count(*) as n from (select clip_id, j - i as key, i - row_number() over (partition by clip_id, j - i order by i) as gg from ln) group by all),
vv as (select clip_id, key, gg, count(*) as n from (select clip_id, j as key, i - row_number() over (partition by clip_id, j order by i) as gg from ln) group by all),
a as (select clip_id, sum(n) as links, coalesce(sum(n) filter (n >= 2), 0) as q, count(*) filter (n >= 2) as k from dd group by 1), b as (select clip_id, sum(n) as links, coalesce(sum(n) filter (n >= 2), 0) as q, count(*) filter (n >= 2) as k from vv group by 1), c as (select clip_id, count(*) as n from v group by 1)
select clip_id, {r("coalesce(a.links, 0) / (c.n * c.n)")} as rr, {r("coalesce(a.q / a.links, 0)")} as det, {r("coalesce(a.q / nullif(a.k, 0), 0)")} as l, {r("coalesce(b.q / b.links, 0)")} as lam, {r("coalesce(b.q / nullif(b.k, 0), 0)")} as tt
from c left join a using (clip_id) left join b using (clip_id)"""

ORACLE_SQL["onset_strength_complex"] = f"""with {E_C}, p as (select *, sqrt(re * re + im * im) as m, atan2(im, re) as a from c), w as (select *, lag(m) over v as m1, lag(a) over v as a1, lag(a, 2) over v as a2 from p window v as (partition by clip_id, k order by t))
select clip_id, cast(t as integer) as t, {r("coalesce(sum(sqrt(pow(re - m1 * cos(2 * a1 - a2), 2) + pow(im - m1 * sin(2 * a1 - a2), 2))), 0)")} as strength from w group by all"""

ORACLE_SQL["local_pulse"] = f"""with {U_S}, g as (select a.clip_id, a.n as i, min(b.n) as lo, max(b.n) as hi, sum(b.x * b.x) as e from s a join s b on a.clip_id = b.clip_id and abs(a.n - b.n) <= 24 group by all),
pr as (select a.clip_id, a.n as n1, b.n as n2, b.n - a.n as lag, a.x * b.x as v from s a join s b on a.clip_id = b.clip_id and b.n - a.n between 2 and 12),
ac as (select g.clip_id, g.i, lag, sum(v) / (any_value(g.e) + 1e-10) as v from g join pr on pr.clip_id = g.clip_id and n1 >= lo and n2 <= hi group by g.clip_id, g.i, lag),
sz as (select clip_id, i, hi - lo + 1 as size from g), be as (select sz.clip_id, sz.i, greatest(max(ac.v), case when any_value(size) <= 12 then 0 end) as best from sz left join ac using (clip_id, i) group by all),
u as (select s.clip_id, n, x * (1 + best) as u from s join be on be.clip_id = s.clip_id and be.i = s.n) select clip_id, cast(n as integer) as i, {r("case when max(u) over (partition by clip_id) > 0 then u / max(u) over (partition by clip_id) else u end")} as x from u"""

ORACLE_SQL["repeating_parts"] = f"""with {BAND}, rk as (select *, row_number() over (partition by clip_id, i order by dist, j) as rank from p), nb as (select clip_id, i, j from rk where rank <= 3),
e as (select clip_id, t, unnest(range(64)) as f, cast(unnest(v) as double) as x from v), q as (select nb.clip_id, i as t, f, x from nb join e on e.clip_id = nb.clip_id and e.t = nb.j), md as (select clip_id, t, f, median(x) as m from q group by all),
ad as (select clip_id, t, f, any_value(m) as m, median(abs(x - m)) as d from q join md using (clip_id, t, f) group by all)
select clip_id, cast(t as integer) as t, cast(f as integer) as f, {r("m")} as repeating, {r("greatest(0, x - m) * (2 - 1 / (1 + abs(x - m) / (d + 1e-10)))")} as other from e join ad using (clip_id, t, f)"""

ORACLE_SQL["split_silence"] = f"""with {U_S}, {LEN}, ts as (select clip_id, unnest(range((len - 8) // 4 + 1)) as t from l where len >= 8), f as (select ts.clip_id, ts.t, sqrt(sum(x * x) / 8) as r from ts join s on s.clip_id = ts.clip_id and s.n between ts.t * 4 and ts.t * 4 + 7 group by all),
a as (select clip_id, t, r from (select *, max(r) over (partition by clip_id) as m from f) where r >= m * pow(10, -6.0 / 20) and r > 0), g as (select clip_id, t, t - row_number() over (partition by clip_id order by t) as isl from a),
sp as (select clip_id, min(t) * 4 as a, least(max(t) * 4 + 8, any_value(len)) as b from g join l using (clip_id) group by clip_id, isl), mk as (select *, case when a - lag(b) over (partition by clip_id order by a) <= 4 then 0 else 1 end as c from sp),
gr as (select *, sum(c) over (partition by clip_id order by a) as g from mk), o as (select clip_id, g, min(a) as a, max(b) as b from gr group by all)
select clip_id, cast(row_number() over (partition by clip_id order by a) - 1 as integer) as seg_id, cast(a as integer) as start, cast(b as integer) as "end" from o"""

ORACLE_SQL["separated_sources"] = f"""with {centred(E_S)}, sc as (select unnest(['low', 'high']) as source), ii as (select unnest(range({N})) as i),
v as (select clip_id, source, t, i, sum(case when (k < 4) = (source = 'low') then case when k in (0, {N // 2}) then re * cos(2 * pi() * k * i / {N}) else 2 * (re * cos(2 * pi() * k * i / {N}) - im * sin(2 * pi() * k * i / {N})) end else 0 end) / {N} as v from c cross join sc cross join ii group by all),
o as (select clip_id, source, t * {HOP} + i - {N // 2} as n, sum(v * {HANN}) / greatest(sum({HANN} * {HANN}), 1e-10) as x from v group by all) select clip_id, source, n, {r("x")} as x from o where n between 0 and 63"""


def _recurrent(kind: str, weights: dict, name: str, reverse: bool) -> str:
    """One direction as a recursive table of the hidden state: (seq_id, t, h)."""
    hidden, gates = weights["hh"].shape[1], {"gru": 3, "lstm": 4}[kind]
    vector = lambda v: "[" + ", ".join(f"{float(x)!r}::double" for x in v) + "]"
    at = "7 - step" if reverse else "step"

    def dot(m: np.ndarray, row: int, of: str) -> str:
        return f"list_dot_product({vector(m[row])}, {of})"

    def gate(g: int, j: int) -> tuple[str, str]:
        row = g * hidden + j
        return f"({dot(weights['ih'], row, 'x')} + {float(weights['bih'][row])!r})", f"({dot(weights['hh'], row, 'h')} + {float(weights['bhh'][row])!r})"

    sig = lambda z: f"(1 / (1 + exp(-({z}))))"
    tanh = lambda z: f"(1 - 2 / (exp(2 * ({z})) + 1))"
    if kind == "gru":
        parts = []
        for j in range(hidden):
            (ar, br), (az, bz), (an, bn) = (gate(g, j) for g in range(gates))
            z = sig(f"{az} + {bz}")
            parts.append(f"(1 - {z}) * {tanh(f'{an} + {sig(f'{ar} + {br}')} * {bn}')} + {z} * h[{j + 1}]")
        new_c, new_h = "c", "[" + ", ".join(parts) + "]"
    else:
        cells, outs = [], []
        for j in range(hidden):
            i, f, z, o = (f"{a} + {b}" for a, b in (gate(g, j) for g in range(gates)))
            cells.append(f"{sig(f)} * c[{j + 1}] + {sig(i)} * {tanh(z)}")
            outs.append(f"{sig(o)} * {tanh(cells[-1])}")
        new_c, new_h = "[" + ", ".join(cells) + "]", "[" + ", ".join(outs) + "]"
    zero = vector(np.zeros(hidden))
    return f"""{name} as (select seq_id, -1 as step, {zero} as h, {zero} as c from q union all
select seq_id, step, {new_h} as h, {new_c} as c from (select r.seq_id, r.step + 1 as step, h, c, list_transform(q.v[({at.replace("step", "(r.step + 1)")}) * 8 + 1 : ({at.replace("step", "(r.step + 1)")}) * 8 + 8], lambda z: cast(z as double)) as x from {name} r join q using (seq_id) where r.step < 7))"""


def _layers(kind: str) -> str:
    fore, back = (recurrent.random_weights(kind, 8, 4, s) for s in (42, 43))
    return f"""with recursive q as (select vec_id as seq_id, embedding as v from embeddings), {_recurrent(kind, fore, "fw", False)}, {_recurrent(kind, back, "bw", True)},
o as (select seq_id, step * 8 as pos, h from fw where step >= 0 union all select seq_id, (7 - step) * 8 + 4, h from bw where step >= 0), e as (select seq_id, pos + unnest(range(4)) as i, unnest(h) as x from o) select seq_id, cast(i as integer) as i, {r("x")} as x from e"""


ORACLE_SQL["gru_outputs"] = _layers("gru")


@query(_layers("lstm"))
def lstm_outputs(spark, sf_dir):
    """Two directions of a long short-term memory over eight frames of eight."""
    rows = emb(spark, sf_dir).select(F.col("clip_id").alias("seq_id"), F.expr("transform(sequence(0, 7), i -> slice(y, i * 8 + 1, 8))").alias("x"))
    w = [recurrent.random_weights("lstm", 8, 4, s) for s in (42, 43)]
    return points(recurrent.run_layers(rows, [w], "lstm").withColumn("z", F.flatten("out")), "z", "seq_id")


@query(f"""select p_partkey, {r("f * 512 / 22050")} as seconds, cast(trunc(p_size * 1000 / 512.0) as bigint) as frame, cast(p_size * 512 as bigint) as samples, {r("440 * pow(2, (p_size + 20 - 69) / 12.0)")} as hz, {r("greatest(0, 24.7 * (4.37 * f / 1000 + 1) - f / (12 / (pow(2, 1 / 12.0) - 1)))")} as gamma,
{r("60 * 43.0 / (p_size + 40)")} as period, {r("32.7 * pow(2, (p_size % 84) / 12.0)")} as bin_hz, cast(least(83, greatest(0, round(12 * log2(f / 32.7)))) as integer) as bin, {r("pow(10, p_size / 10.0)")} as power, {r("pow(10, p_size / 20.0)")} as amplitude, {r("20 * log10(greatest(f, 1e-5))")} as amplitude_db,
{r("700 * (exp(p_size / 1127.0) - 1)")} as kaldi_hz, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], cast(p_size % 12 + 1 as integer)) as class from (select p_partkey, p_size, p_retailprice as f from part)""")
def time_and_bin_conversions(spark, sf_dir):
    f, n = F.col("p_retailprice"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        "p_partkey", r6(units.frames_to_times(f, 22050, 512)).alias("seconds"), units.samples_to_frames(n * 1000, 512).alias("frame"), units.frames_to_samples(n, 512).alias("samples"), r6(units.midi_to_hz(n + 20)).alias("hz"),
        r6(units.gamma_for_erb(f)).alias("gamma"), r6(units.bpm_to_frames(n + 40, 43.0)).alias("period"), r6(units.bin_to_hz(n % 84, 32.7)).alias("bin_hz"), units.hz_to_bin(f, 32.7, 84).alias("bin"), r6(units.db_to_power(n)).alias("power"),
        r6(units.db_to_amplitude(n)).alias("amplitude"), r6(units.amplitude_to_db(f)).alias("amplitude_db"), r6(units.mel_to_hz_kaldi(n)).alias("kaldi_hz"), units.pitch_class_name(n % 12).alias("class"),
    )


@query("select p_partkey, round(440 * pow(2, (p_size + 20 - 69) / 12.0), 4) as hz from part")
def note_round_trip(spark, sf_dir):
    """Numbers to frequencies, to names of notes, and back."""
    return read(spark, sf_dir, "part").select("p_partkey", F.round(units.note_to_hz(units.hz_to_note(units.midi_to_hz(F.col("p_size") + 20))), 4).alias("hz"))


@query(f"with {E_S} select a.clip_id, cast(a.n as integer) as i, {r('(a.x + b.x) / 2')} as mono, {r('0.25 * a.x + 0.75 * b.x')} as mixed, {r('a.x')} as right from s a join s b on a.clip_id = b.clip_id and b.n = 63 - a.n")
def channel_mixes(spark, sf_dir):
    rows = emb(spark, sf_dir).withColumn("z", F.reverse("y")).withColumn("channels", F.array("y", "z"))
    made = rows.select("clip_id", frames.mono().alias("a"), frames.mix_stereo("y", "z", 0.25, 0.75).alias("b"), F.element_at(frames.to_stereo("y"), 2).alias("c"))
    return made.select("clip_id", F.posexplode(F.arrays_zip("a", "b", "c")).alias("i", "q")).select("clip_id", "i", r6("q.a").alias("mono"), r6("q.b").alias("mixed"), r6("q.c").alias("right"))


@query(f"with {E_S} select clip_id, cast(n as integer) as i, {r('x / sqrt(greatest(sum(x * x) over (partition by clip_id), 1e-10))')} as x from s")
def unit_frames(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", features.unit_frames("y")), "z", "clip_id")


@query(f"with {E_S} select clip_id, cast(arg_min(n, -x * 1.0) as integer) as at, round(sum(x), 5) + 0.0 as total, round(avg(x), 5) + 0.0 as mean, round(sum(x * x), 5) as dot from s group by 1")
def array_sums(spark, sf_dir):
    return emb(spark, sf_dir).select("clip_id", features.argmax("y").alias("at"), *(F.round(F.expr(x), 5).alias(n) for x, n in ((arrays.total("y"), "total"), (arrays.mean("y"), "mean"), (arrays.dot("y", "y"), "dot"))))


@query(f"with {E_S}, d as (select clip_id, n, x - lag(x) over (partition by clip_id order by n) as d from s) select clip_id, cast(n - 1 as integer) as i, {r('d')} as x from d where n > 0")
def first_differences(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", temporal.intervals("y")), "z", "clip_id")


@query(f"with {E_S}, w as (select n, case when n / 63.0 <= 0.5 then n / 63.0 * 0.5 else 0.25 + (n / 63.0 - 0.5) * 1.5 end * 63 as u from (select unnest(range(64)) as n)) select a.clip_id, cast(w.n as integer) as i, {r('a.x + (u - floor(u)) * (b.x - a.x)')} as x from w join s a on a.n = floor(u) join s b on b.clip_id = a.clip_id and b.n = least(63, floor(u) + 1)")
def time_warp(spark, sf_dir):
    return points(emb(spark, sf_dir).withColumn("z", frames.time_warp("y", [(0.0, 0.0), (0.5, 0.25), (1.0, 1.0)])), "z", "clip_id")


@query(f"with {E_M}, d as (select clip_id, t, v - lag(v) over (partition by clip_id, k order by t) as d from m) select clip_id, cast(t as integer) as t, {r('coalesce(sum(greatest(d, 0)), 0)')} as strength from d group by all")
def onset_strength_flux(spark, sf_dir):
    return events.onset_strength(magnitudes(spark, sf_dir), "flux").withColumn("strength", r6("strength"))


@query(f"with {E_M}, e as (select clip_id, t, sqrt(avg(v * v)) as e from m group by all) select clip_id, cast(t as integer) as t, {r('coalesce(greatest(0, e - lag(e) over (partition by clip_id order by t)), 0)')} as strength from e")
def onset_strength_rms(spark, sf_dir):
    return events.onset_strength(magnitudes(spark, sf_dir), "rms").withColumn("strength", r6("strength"))


@query(ORACLE_SQL["split_silence"].rsplit("\nselect", 1)[0] + '\nselect clip_id, min(a) as start, max(b) as "end" from o group by 1')
def trim_silence(spark, sf_dir):
    clips = samples(spark, sf_dir)
    return events.trim_silence(events.split_silence(frames.frame(clips, 8, 4), clips.groupBy("clip_id").agg((F.max("n") + 1).alias("n_samples")), 8, 4, 6.0)).select("clip_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"with {BAND} select clip_id, cast(i as integer) as i, cast(j as integer) as j, {r('dist')} as dist from p order by round(dist, 9), clip_id, i, j limit 20")
def closest_links(spark, sf_dir):
    links = similarity.recurrence(labelled_frames(spark, sf_dir), width=5)
    return tall_rounded(similarity.closest(links.withColumn("dist", F.round("dist", 9)), 20), "dist")


@query(f"""with {U_S}, {LEN}, w as (select s.clip_id, t, n - t as i, x * (0.5 - 0.5 * cos(2 * pi() * (n - t) / 32)) as x from s join l using (clip_id) join (select unnest(range(0, 400, 4)) as t) on n between t and t + 31 and t + 32 <= len), kk as (select unnest(range(2, 17)) as k)
select clip_id, cast(t // 4 as integer) as t, cast(k as integer) as k, round(2 * sqrt(pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2)), 4) + 0.0 as value from w cross join kk group by all""")
def fourier_tempogram(spark, sf_dir):
    rows = temporal.tempogram(samples(spark, sf_dir), 32, 4, fps=1.0, bpm=(3.0, 30.0), kind="fourier")
    return rows.select("clip_id", "t", F.col("k").cast("int").alias("k"), F.round("value", 4).alias("value"))


def _pseudo() -> np.ndarray:
    freqs, width = 4.0 * 2.0 ** (np.arange(12) / 12), 4.0 * 2.0 ** (np.arange(12) / 12) * (2 ** (1 / 12) - 1)
    w = np.maximum(0, 1 - np.abs((np.arange(N // 2 + 1) * SR / N)[None, :] - freqs[:, None]) / np.maximum(width, SR / N)[:, None])
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-10)


@query(f"with {centred(E_S)}, {values('pw', _pseudo())} select clip_id, cast(t as integer) as t, cast(m as integer) as k, {r('sum(sqrt(re * re + im * im) * w)')} as x from c join pw using (k) group by all")
def pseudo_cqt(spark, sf_dir):
    return points(spectral.pseudo_cqt(emb(spark, sf_dir), SR, N, HOP, 4.0, 12), "v", "clip_id", "t", name="k")


@query(f"with {E_C} select clip_id, cast(t as integer) as t, cast(k as integer) as k, {r('re')} as re, {r('im')} as im from c")
def polar_round_trip(spark, sf_dir):
    s = spectral.stft(emb(spark, sf_dir), N, HOP, center=False)
    polar = spectral.magnitude(s).withColumnRenamed("v", "mag").join(spectral.phase(s).withColumnRenamed("v", "angle"), ["clip_id", "t"])
    z = spectral.from_polar(polar).select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return z.select("clip_id", "t", "k", r6("z.re").alias("re"), r6("z.im").alias("im"))


@query(f"""with {E_S}, w as (select a.clip_id, a.n, b.n as m, b.x from s a join s b on a.clip_id = b.clip_id and b.n <= a.n and a.n - b.n <= 6 where a.n % 8 = 7), st as (select *, min(x) over (partition by clip_id, n order by m desc rows between unbounded preceding and 1 preceding) as low from w),
g as (select *, max(case when m < n and x > 1.1 * low then 1 else 0 end) over (partition by clip_id, n order by m desc) as over from st) select clip_id, cast(row_number() over (partition by clip_id order by n) - 1 as integer) as i, cast(arg_min(m, x) as double) as x from g where over = 0 group by clip_id, n""")
def backtracked(spark, sf_dir):
    """From every eighth sample back to the lowest place near it."""
    rows = emb(spark, sf_dir).withColumn("p", F.expr("transform(sequence(0, 7), k -> k * 8 + 7)"))
    return points(rows.withColumn("z", events.backtrack("y", "p", 6)), "z", "clip_id")


@query(f"""with {U_S}, a as (select clip_id, n, x, count(*) over w as c, avg(x) over w as m, avg(x * x) over w as q from s window w as (partition by clip_id order by n))
select clip_id, cast(n as integer) as t, cast(0 as integer) as i, round(case when c >= 10 then (x - m) / sqrt(greatest(q - m * m, 1e-10)) else x end, 5) + 0.0 as x from a""")
def streamed_normalise(spark, sf_dir):
    from wavemill.streaming.state import run_available, stream_normalise

    rows = samples(spark, sf_dir).select("clip_id", F.col("n").alias("t"), F.array("x").alias("v"))
    made = run_available(rows, stream_normalise)
    return made.select("clip_id", "t", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 5))


@query(f"with {yin(False)}")
def streamed_pitch(spark, sf_dir):
    from wavemill.streaming.state import run_available, stream_pitch

    p = run_available(frames.chunk_rows(samples(spark, sf_dir), 10), lambda s: stream_pitch(s, SR, 32, 8, 4.0, 20.0))
    return p.select("clip_id", "t", r6("pitch").alias("pitch"), r6("confidence").alias("confidence"))


@query(f"""with {U_S}, {LEN}, ts as (select clip_id, unnest(range(case when len < {N} then 1 else (len - {N}) // {HOP} + 2 end)) as t from l), fr as (select ts.clip_id, ts.t, n - ts.t * {HOP} as i, x from ts join s on s.clip_id = ts.clip_id and n between ts.t * {HOP} and ts.t * {HOP} + {N - 1}),
c as (select clip_id, t, k, sum(x * {HANN} * cos(2 * pi() * k * i / {N})) as re, -sum(x * {HANN} * sin(2 * pi() * k * i / {N})) as im from fr cross join {K} group by clip_id, t, k), {values("mw", spectral.mel_weights(6, N, SR, style="htk"))}
select clip_id, cast(t as integer) as t, cast(m as integer) as m, {r("10 * log10(greatest(sum((re * re + im * im) * w), 1e-10))")} as x from c join mw using (k) group by all""")
def streamed_features(spark, sf_dir):
    from wavemill.streaming.state import run_available, stream_features

    weights = spectral.mel_weights(6, N, SR, style="htk")
    return points(run_available(frames.chunk_rows(samples(spark, sf_dir), 10), lambda s: stream_features(s, N, HOP, weights)), "v", "clip_id", "t", name="m")


def clean(make):
    """The query with its negative zeros made zeros, as the SQL has them."""

    def run(spark, sf_dir: str) -> DataFrame:
        rows = make(spark, sf_dir)
        return rows.select(*((F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))

    return run
