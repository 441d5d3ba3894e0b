"""Operators on clips cut into blocks, against the same on whole clips or plain loops, with blocks so small that every border is met."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import alignment, blocks, decompose, events, frames, order, rates, scan, similarity, spectral, statistics, temporal


def tall(spark, *signals):
    return spark.createDataFrame([(k, n, float(x)) for k, s in enumerate(signals) for n, x in enumerate(s)], "clip_id long, n int, x double").repartition(3)


def spectra_rows(spark, *clips):
    return spark.createDataFrame([(k, t, v.tolist()) for k, c in enumerate(clips) for t, v in enumerate(c)], "clip_id long, t int, v array<double>").repartition(3)


@pytest.mark.parametrize(("n_fft", "hop", "trim", "per"), [(16, 4, 8, 5), (16, 4, 0, 5), (10, 4, 5, 3), (8, 8, 0, 2), (6, 8, 0, 3), (16, 4, 8, None)])
def test_overlap_add_by_blocks(spark, n_fft, hop, trim, per):
    rng = np.random.default_rng(n_fft + trim)
    clips = [rng.normal(size=(t, n_fft)) for t in (1, 2, 5, 10, 11, 23)]
    w = rng.random(n_fft) + 0.1
    got = blocks.samples_of(blocks.overlap_add_blocks(spectra_rows(spark, *clips), n_fft, hop, w, trim, per=per))
    found = {(r.clip_id, r.n): r.x for r in got.collect()}
    want = {}
    for k, c in enumerate(clips):
        total, weight = np.zeros((len(c) - 1) * hop + n_fft), np.zeros((len(c) - 1) * hop + n_fft)
        for t, v in enumerate(c):
            total[t * hop : t * hop + n_fft] += v * w
            weight[t * hop : t * hop + n_fft] += w * w
        end = (len(c) - 1) * hop + (0 if trim else n_fft)
        for n in range(end):
            want[k, n] = total[n + trim] / max(weight[n + trim], 1e-10)
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()))


def test_overlap_add_shuffles_each_frame_about_once(spark):
    plan = blocks.overlap_add_blocks(spectra_rows(spark, np.ones((300, 16))), 16, 4, np.ones(16), 8)
    rows = plan.select("clip_id", "n", F.size("y").alias("k")).collect()
    assert sorted(r.n for r in rows) == [0, *(64 * 4 * b - 8 for b in range(1, 5))] and sum(r.k for r in rows) == 299 * 4


@pytest.mark.parametrize(("length", "hop", "pad", "size"), [(8, 4, 0, 16), (8, 4, 4, 16), (8, 3, 4, 9), (5, 7, 2, 6), (4, 1, 3, 4)])
def test_frames_of_blocks(spark, length, hop, pad, size):
    rng = np.random.default_rng(length * hop + pad)
    clips = [rng.normal(size=n) for n in (1, 3, 8, 16, 17, 20, 31, 33, 64)]
    got = blocks.frames_of(blocks.sample_blocks(tall(spark, *clips), size), length, hop, pad, size)
    found = {(r.clip_id, r.t): r.v for r in got.collect()}
    want = {}
    for k, c in enumerate(clips):
        x = np.r_[np.zeros(pad), c, np.zeros(pad)]
        want |= {(k, t): x[t * hop : t * hop + length].tolist() for t in range((len(x) - length) // hop + 1) if len(x) >= length}
    assert found == want


def plain_griffin_lim(mag, n_fft, hop, rounds, momentum, angle):
    w = np.asarray(spectral.window_values("hann", n_fft))
    project = blocks.Projection(hop, w, lambda c: np.fft.irfft(c, n=n_fft, axis=2), lambda v: np.fft.rfft(v * w, axis=2), n_fft)
    c, before, best = mag * np.exp(1j * angle), None, (math.inf, None)
    for _ in range(rounds):
        made = project(c[None], True, True)[0]
        error = ((np.abs(made) - mag) ** 2).sum()
        turned = made if before is None or not momentum else made - momentum / (1 + momentum) * before
        before, c = made, mag * np.exp(1j * np.angle(turned))
        if error < best[0]:
            best = (error, c)
    return best[1]


@pytest.mark.parametrize("momentum", [0.0, 0.99])
def test_rounds_by_blocks_are_those_of_whole_clips(spark, momentum):
    rng = np.random.default_rng(7)
    signals = [np.sin(np.arange(n) / (3 + k)) + 0.1 * rng.normal(size=n) for k, n in enumerate((40, 300, 333))]
    mags = [np.abs(np.array([np.fft.rfft(np.hanning(16) * np.r_[np.zeros(8), s, np.zeros(8)][t * 4 : t * 4 + 16]) for t in range(len(s) // 4 + 1)])) for s in signals]
    angle = lambda k, t, i: (k * 7 + t * 3 + i * 5) % 11 / 11 * 2 * np.pi
    start = blocks.polar_start(spectra_rows(spark, *mags), "pmod(clip_id * 7 + t * 3 + i * 5, 11) / 11 * 2 * pi()")
    w = np.asarray(spectral.window_values("hann", 16))
    project = blocks.Projection(4, w, lambda c: np.fft.irfft(c, n=16, axis=2), lambda v: np.fft.rfft(v * w, axis=2), 16)
    assert project.reach == 3
    for rounds, at_once, per in ((6, 2, 9), (7, 3, 20), (7, 8, None)):
        found = {(r.clip_id, r.t): np.array(r.re) + 1j * np.array(r.im) for r in blocks.rebuilt(start, project, rounds, momentum, at_once, per).collect()}
        for k, mag in enumerate(mags):
            first = np.array([[angle(k, t, i) for i in range(9)] for t in range(len(mag))])
            want = plain_griffin_lim(mag, 16, 4, rounds, momentum, first)
            got = np.array([found[k, t] for t in range(len(mag))])
            assert np.allclose(got, want, atol=1e-7)


def test_griffin_lim_comes_near_the_magnitudes(spark):
    y = np.sin(np.arange(4000) / 9) * np.hanning(4000)
    clips = spark.createDataFrame([(0, y.tolist())], "clip_id long, y array<double>")
    mags = spectral.magnitude(spectral.stft(clips, 64, 16))
    back = spectral.griffin_lim(mags, 64, 16).orderBy("n").toPandas().x.to_numpy()
    again = spark.createDataFrame([(0, back.tolist())], "clip_id long, y array<double>")
    a, b = (np.array([r.v for r in m.orderBy("t").collect()]) for m in (mags, spectral.magnitude(spectral.stft(again, 64, 16))))
    assert np.linalg.norm(a[: len(b)] - b) / np.linalg.norm(a) < 0.25


def test_inverse_of_constant_q_magnitudes(spark):
    y = np.sin(2 * np.pi * 8 * np.arange(512) / 64)
    clips = spark.createDataFrame([(0, y.tolist())], "clip_id long, y array<double>")
    mags = spectral.magnitude(spectral.cqt(clips, 64.0, 4, 4.0, 24))
    errors = []
    for rounds in (1, 32):
        back = rates.inverse_cqt_magnitude(mags, 64.0, 4, 4.0, 24, rounds=rounds).orderBy("n").toPandas().x.to_numpy()
        again = spectral.magnitude(spectral.cqt(spark.createDataFrame([(0, back.tolist())], "clip_id long, y array<double>"), 64.0, 4, 4.0, 24))
        a, b = (np.array([r.v for r in m.orderBy("t").collect()]) for m in (mags, again))
        n = min(len(a), len(b))
        a, b = (m[:n] / np.linalg.norm(m[:n]) for m in (a, b))
        errors.append(np.linalg.norm(a - b))
    assert errors[1] < errors[0]


@pytest.mark.parametrize("decay", [0.9, 0.5, 1.0])
def test_recurrence_is_the_loop(spark, decay):
    rng = np.random.default_rng(2)
    signals = [rng.normal(size=n) for n in (1, 6, 7, 8, 50, 100)]
    values = tall(spark, *signals).withColumnRenamed("n", "t")
    initial = spark.createDataFrame([(k, [float(k)]) for k in (1, 4, 5)], "clip_id long, s array<double>")
    for steps, group, first in ((7, 3, None), (7, 3, initial), (4096, 4096, None), (1, 2, initial)):
        cut = scan.blocks_of(values, ["clip_id"], steps=steps)
        rows = scan.recurrence(cut, ["clip_id"], decay, 0.3, 2.0, first, group=group)
        got = {(r.clip_id, r.t): (r.y, r.p) for r in scan.unrolled(rows, ["clip_id"], y="s", p="v").collect()}
        before = {(r.clip_id, r.t): r.y for r in scan.unrolled(scan.recurrence(cut, ["clip_id"], decay, 0.3, 2.0, first, True, group), ["clip_id"], y="s").collect()}
        ends = {r.clip_id: r.s for r in scan.final_states(rows, ["clip_id"]).collect()}
        for k, x in enumerate(signals):
            s = float(k) if first is not None and k in (1, 4, 5) else 2.0
            for t, v in enumerate(x):
                assert math.isclose(before[k, t], s, abs_tol=1e-9)
                s = decay * s + 0.3 * v
                assert math.isclose(got[k, t][0], s, abs_tol=1e-9) and got[k, t][1] == v
            assert np.allclose(ends[k], [s])


def test_normalisation_goes_on_from_a_state(spark):
    rng = np.random.default_rng(3)
    rows = [(0, f, t, float(x)) for f in range(2) for t, x in enumerate(rng.random(60))]
    values = spark.createDataFrame(rows, "clip_id long, f int, t int, x double")
    whole = {(r.f, r.t): r.y for r in temporal.pcen(values, b=0.2).collect()}
    state = temporal.pcen_state(values.where("t < 25"), b=0.2)
    later = {(r.f, r.t): r.y for r in temporal.pcen(values.where("t >= 25"), b=0.2, initial=state).collect()}
    assert len(later) == 70 and all(math.isclose(whole[k], y, rel_tol=1e-9) for k, y in later.items())


def test_emphasis_of_tall_samples(spark):
    rng = np.random.default_rng(4)
    signals = [rng.normal(size=n) for n in (2, 3, 30, 31)]
    samples = tall(spark, *signals)
    there = temporal.preemphasis_tall(samples, steps=8)
    plain = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)], "clip_id long, y array<double>").select("clip_id", temporal.preemphasis().alias("z"))
    want = {(r.clip_id, n): x for r in plain.collect() for n, x in enumerate(r.z)}
    got = {(r.clip_id, r.n): r.x for r in there.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    back = {(r.clip_id, r.n): r.x for r in temporal.deemphasis_tall(there, steps=8).collect()}
    assert all(np.allclose([back[k, n] for n in range(len(s))], s) for k, s in enumerate(signals))


def plain_alignment(cost, subsequence=False):
    n, m = cost.shape
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0
    if subsequence:
        acc[0] = 0
    for i in range(n):
        for j in range(m):
            acc[i + 1, j + 1] = cost[i, j] + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    j = int(acc[n, 1:].argmin()) if subsequence else m - 1
    best, i, path = acc[n, j + 1], n - 1, []
    if not np.isfinite(best):
        return None, []
    while True:
        path.append((i, j))
        if i == 0 and (subsequence or j == 0):
            return best, path[::-1]
        k = int(np.argmin((acc[i, j], acc[i, j + 1], acc[i + 1, j])))
        i, j = i - (k < 2), j - (k != 1)


def plain_window(n, m, window, param):
    ok = np.ones((n, m), dtype=bool)
    for i in range(n):
        for j in range(m):
            if window == "band":
                ok[i, j] = abs(j - i * m // n) <= param
            elif window == "itakura" and (i, j) not in ((0, 0), (n - 1, m - 1)):
                if i > 0 and not 1 / param <= (j / i) / (m / n) <= param:
                    ok[i, j] = False
                if i < n - 1 and not 1 / param <= ((m - 1 - j) / (n - 1 - i)) / (m / n) <= param:
                    ok[i, j] = False
    return ok


@pytest.mark.parametrize(("window", "param", "subsequence", "metric"), [(None, None, False, "euclidean"), (None, None, True, "manhattan"), ("band", 3, False, "euclidean"), ("itakura", 2, False, "cosine"), ("band", 0, False, "euclidean")])
def test_alignment_by_tiles(spark, window, param, subsequence, metric):
    rng = np.random.default_rng(8)
    sizes = [(1, 1), (1, 9), (9, 1), (5, 5), (12, 12), (13, 20), (21, 16)]
    pairs = [(rng.integers(0, 3, (n, 2)).astype(float), rng.integers(0, 3, (m, 2)).astype(float)) for n, m in sizes]
    x, y = (spectra_rows(spark, *(p[k] for p in pairs)).withColumnRenamed("clip_id", "pair_id") for k in (0, 1))
    costs, path = alignment.align_tall(x, y, metric, subsequence, window, param, tile=8)
    got = {r.pair_id: r for r in costs.collect()}
    steps: dict[int, list] = {}
    for r in path.collect():
        steps.setdefault(r.pair_id, []).append((r.i, r.j))
    rows = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(pairs)] + [(99, [], [[1.0, 1.0]])], "pair_id long, x array<array<double>>, y array<array<double>>")
    short = {r.pair_id: r for r in alignment.align(rows, metric, subsequence, window, param).collect()}
    assert short[99].cost is None and short[99].path == []
    for k, (a, b) in enumerate(pairs):
        cost = alignment.costs(a, b, metric)
        if window:
            cost = np.where(plain_window(*cost.shape, window, param), cost, np.inf)
        best, want = plain_alignment(cost, subsequence)
        if best is None:
            assert got[k].cost is None and got[k].steps == 0 and k not in steps and short[k].cost is None
            continue
        assert math.isclose(got[k].cost, best) and math.isclose(short[k].cost, best)
        assert sorted(steps[k]) == sorted(want) and got[k].steps == len(want) and [(p.i, p.j) for p in short[k].path] == want


def test_factors_stop_at_the_tolerance(spark):
    rng = np.random.default_rng(6)
    v = rng.random((50, 3)) @ rng.random((3, 7)) + 0.01 * rng.random((50, 7))
    rows = spectra_rows(spark, v)
    b, level = decompose.first_basis(7, 3), float(decompose.first_basis(7, 3).mean()) * 3
    h, errors = np.repeat(v.mean(axis=1)[:, None] / level, 3, axis=1), []
    for _ in range(40):
        h = np.maximum(1e-10, h * (v @ b.T) / (h @ b @ b.T + 1e-10))
        b = np.maximum(1e-10, b * (h.T @ v) / (h.T @ h @ b + 1e-10))
        errors.append(np.linalg.norm(v - h @ b))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) / (errors[-2] + 1e-10) < 0.02:
            break
    for keep in (1, 3, 50):
        found = decompose.nmf(rows, 7, 3, 40, 0.02, keep=keep)
        assert np.allclose(found.errors, errors, rtol=1e-6) and np.allclose(found.basis, b) and sorted(found.errors, reverse=True) == found.errors
        assert np.allclose([r.v for r in found.activations.orderBy("t").collect()], h)


def test_stretch_of_a_long_clip_by_blocks(spark):
    """Phases are summed over several blocks of frames."""
    y = np.sin(2 * np.pi * 250 * np.arange(20_000) / 4000)
    clips = spark.createDataFrame([(0, y.tolist())], "clip_id long, y array<double>")
    back = spectral.time_stretch(clips, 0.8, 64, 16).orderBy("n").toPandas().x.to_numpy()
    spectrum = np.abs(np.fft.rfft(back[1000:21_480]))
    assert abs(spectrum.argmax() * 4000 / 20_480 - 250) < 2 and len(back) > 24_000


def test_tall_frames_match_short_ones(spark):
    y = np.arange(100.0)
    clips = spark.createDataFrame([(0, y.tolist())], "clip_id long, y array<double>")
    a, b = ({r.t: r.v for r in f.collect()} for f in (frames.frame(clips, 16, 5, 8), frames.frame_tall(frames.tall(clips), 16, 5, 8)))
    assert a == b


def test_medians_of_long_clips_by_blocks(spark):
    rng = np.random.default_rng(11)
    clips = [rng.integers(0, 9, (n, 6)).astype(float) for n in (1, 3, 64, 200)]
    plain = lambda x, size: [sorted(x[max(0, i - size // 2) : i + size // 2 + 1])[min(len(x), i + size // 2 + 1) - max(0, i - size // 2) >> 1] for i in range(len(x))]
    for a, b in ((7, 5), (1, 3), (31, 31)):
        got = {(r.clip_id, r.t): (r.harmonic, r.percussive) for r in decompose.hpss_frames(spectra_rows(spark, *clips), a, b).collect()}
        assert len(got) == sum(map(len, clips))
        for k, c in enumerate(clips):
            h = np.array([plain(c[:, f].tolist(), a) for f in range(6)]).T ** 2
            p = np.array([plain(v.tolist(), b) for v in c]) ** 2
            assert np.allclose([got[k, t] for t in range(len(c))], np.stack([h / (h + p + 1e-10), p / (h + p + 1e-10)], axis=1))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_neighbours_of_long_clips_by_blocks(spark, metric):
    """Small whole numbers, so that many distances are equal and ties go by place."""
    rng = np.random.default_rng(12)
    clips = [rng.integers(0, 3, (n, 3)).astype(float) for n in (1, 2, 5, 150)]
    rows = spectra_rows(spark, *clips)
    pairs = {(r.clip_id, r.i, r.j): r.dist for r in similarity.band_pairs(rows, 4, metric).collect()}
    near = {(r.clip_id, r.i, r["rank"]): r.j for r in similarity.nearest_in_band(rows, 4, 3, metric).collect()}
    filtered = {(r.clip_id, r.t): r.v for r in similarity.neighbour_filter(rows, 4, 3, "median", metric).collect()}
    want, first, medians = {}, {}, {}
    for k, c in enumerate(clips):
        dist = alignment.costs(c, c, metric)
        for i in range(len(c)):
            own = [(float(np.round(dist[i, j], 12)), j) for j in range(max(0, i - 4), min(len(c), i + 5)) if j != i]
            want |= {(k, i, j): d for d, j in own}
            chosen = sorted(own)[:3]
            first |= {(k, i, n + 1): j for n, (_, j) in enumerate(chosen)}
            if chosen:
                medians[k, i] = np.median([c[j] for _, j in chosen], axis=0)
    assert pairs.keys() == want.keys() and np.allclose([pairs[x] for x in want], list(want.values()))
    if metric != "cosine":  # whose equal distances differ in their last digits
        assert near == first and filtered.keys() == medians.keys() and all(np.allclose(filtered[x], medians[x]) for x in medians)


def test_order_statistics_of_groups(spark):
    rng = np.random.default_rng(13)
    groups = {"a": rng.integers(0, 5, 500).astype(float), "b": rng.normal(size=37), None: rng.normal(size=4), "d": np.array([2.0])}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("b", None), ("e", None)], "g string, x double").repartition(5)
    places = order.placed(rows, ["g"], "x")
    seen = {(r.g, r.x): (r.n, r.before) for r in places.collect()}
    for g, v in groups.items():
        for x in v:
            assert seen[g, x] == ((v == x).sum(), (v < x).sum())
    got = {r.g: r for r in statistics.summary(rows, ["g"], "x").collect()}
    late = {r.g: r for r in statistics.latency(rows, ["g"], "x", 1.0).collect()}
    for g, v in groups.items():
        assert np.allclose([got[g].p50, got[g].p90, got[g].p95, got[g].p99], np.percentile(v, [50, 90, 95, 99])) and got[g].n == len(v)
        assert late[g].p95 == np.sort(v)[min(len(v) - 1, math.floor(len(v) * 0.95))]
    left = {}
    for r in events.without_outliers(rows, ["g"], "x").collect():
        left.setdefault(r.g, []).append(r.x)
    for g, v in groups.items():
        s = np.sort(v)
        a, b = s[len(s) // 4], s[3 * len(s) // 4]
        assert sorted(left[g]) == [x for x in s if a - 1.5 * (b - a) <= x <= b + 1.5 * (b - a)]


@pytest.mark.parametrize(("a", "b", "quality"), [(2, 3, "low"), (3, 2, "medium"), (4, 1, "high"), (1, 4, "very_high"), (48000, 44100, "medium")])
def test_polyphase_by_blocks_and_by_definition(spark, a, b, quality):
    rng = np.random.default_rng(14)
    signals = [rng.normal(size=n) for n in (1, 40, 79, 80, 81, 400)]
    change = rates.Polyphase.of(a, b, quality)
    clips = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)], "clip_id long, y array<double>")
    whole = {r.clip_id: np.array(r.y) for r in rates.resample(clips, a, b, quality).collect()}
    parts = blocks.samples_of(rates.resample_blocks(blocks.sample_blocks(frames.tall(clips), 80), a, b, quality, 80))
    cut = {}
    for r in parts.orderBy("clip_id", "n").collect():
        cut.setdefault(r.clip_id, []).append(r.x)
        assert r.n == len(cut[r.clip_id]) - 1
    for k, s in enumerate(signals):
        up = np.zeros(len(s) * change.up)
        up[:: change.up] = s
        full = np.convolve(up, change.taps)[len(change.taps) // 2 :] * change.up
        want = full[np.arange(len(s) * change.up // change.down) * change.down]
        assert np.allclose(whole[k], want) and np.allclose(cut.get(k, []), want)


def test_polyphase_keeps_what_is_below_and_drops_what_is_above(spark):
    n = np.arange(8000)
    for f, gain in ((500, 1.0), (3500, 0.0)):
        clips = spark.createDataFrame([(0, np.sin(2 * np.pi * f * n / 8000).tolist())], "clip_id long, y array<double>")
        y = np.array(rates.resample(clips, 8000, 4000, "very_high").first().y)
        assert len(y) == 4000 and abs(np.abs(y[200:-200]).max() - gain) < 0.01


@pytest.mark.parametrize(("length", "hop", "pad", "size"), [(8, 4, 4, 16), (8, 3, 6, 9), (4, 1, 3, 4), (16, 4, 8, 32)])
def test_reflected_frames_of_blocks(spark, length, hop, pad, size):
    """As those of whole arrays, for clips shorter than their padding and ends near a block's edge."""
    rng = np.random.default_rng(length)
    clips = [rng.normal(size=n) for n in (1, 2, 3, 5, 8, 9, 16, 17, 18, 31, 33, 64, 65)]
    got = {(r.clip_id, r.t): r.v for r in blocks.frames_of(blocks.sample_blocks(tall(spark, *clips), size), length, hop, pad, size, "reflect").collect()}
    arrays = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(clips)], "clip_id long, y array<double>")
    assert got == {(r.clip_id, r.t): r.v for r in frames.frame(arrays, length, hop, pad, "reflect").collect()}


def test_spectra_of_arrays_and_of_tall_samples(spark):
    rng = np.random.default_rng(15)
    signals = [rng.normal(size=n) for n in (3, 16, 40, 100)]
    arrays = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)] + [(9, [])], "clip_id long, y array<double>")
    for center, mode, window in ((True, "constant", "hann"), (True, "reflect", "blackman"), (False, "constant", "hamming")):
        a, b = ({(r.clip_id, r.t): (r.re, r.im) for r in spectral.stft(c, 16, 5, window, 12, center, mode).collect()} for c in (arrays, tall(spark, *signals)))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
        w = np.r_[spectral.window_values(window, 12), np.zeros(4)]
        for k, s in enumerate(signals):
            x = np.pad(s, 8 if center else 0, mode=mode) if center and (mode == "constant" or len(s) > 8) else s if not center else None
            for t in range((len(x) - 16) // 5 + 1 if x is not None and len(x) >= 16 else 0):
                c = np.fft.rfft(x[t * 5 : t * 5 + 16] * w)
                assert np.allclose(a[k, t], (c.real, c.imag))


def test_chunks_of_tall_samples(spark):
    signals = [np.arange(n, dtype=float) for n in (1, 9, 10, 11, 35)]
    arrays = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)], "clip_id long, y array<double>")
    a, b = (sorted((r.clip_id, r.seq, r.y, r["last"]) for r in frames.chunk_rows(c, 10).collect()) for c in (arrays, tall(spark, *signals)))
    assert a == b


@pytest.mark.parametrize("per", [3, 7, 1 << 16])
def test_runs_by_stretches(spark, per):
    """Islands, smoothing and segments with stretches so short that runs cross several, gaps in the frame numbers, nulls."""
    rng = np.random.default_rng(per)
    flags = {k: [(int(t), bool(rng.random() < 0.6)) for t in np.flatnonzero(rng.random(n) < keep)] for k, (n, keep) in enumerate([(40, 1.0), (60, 0.7), (1, 1.0), (30, 0.2)])}
    rows = spark.createDataFrame([(k, t, f, float(t)) for k, v in flags.items() for t, f in v], "clip_id long, t int, active boolean, x double").repartition(3)

    def runs(v):
        out = []
        for t, f in v:
            if out and out[-1][0] == f:
                out[-1][1].append(t)
            else:
                out.append((f, [t]))
        return out

    got = {(r.clip_id, r.seg_id): (r.start, r.end, r.score) for r in events.segments(rows, "active", "x", per).collect()}
    want = {}
    for k, v in flags.items():
        for n, (_, ts) in enumerate(x for x in runs(v) if x[0]):
            want[k, n] = (ts[0], ts[-1] + 1, np.mean(ts))
    assert got == want
    smooth = {(r.clip_id, r.t): r.active for r in events.smooth_activity(rows, 3, 4, per=per).collect()}
    for k, v in flags.items():
        first = [(t, f and len(ts) >= 3) for f, ts in runs(v) for t in ts]
        r = runs(first)
        for n, (f, ts) in enumerate(r):
            for t in ts:
                assert smooth[k, t] == (f or (0 < n < len(r) - 1 and len(ts) < 4))


def test_synchronise_by_stretches(spark):
    clips = [np.arange(n, dtype=float)[:, None] for n in (1, 10, 50)]
    rows = spectra_rows(spark, *clips)
    bounds = spark.createDataFrame([(2, b) for b in (0, 5, 6, 30, 31, 49, 50, 99)] + [(1, 4)], "clip_id long, b int")
    got = {per: sorted((r.clip_id, r.seg, r.v[0]) for r in similarity.synchronise(rows, bounds, "sum", per).collect()) for per in (4, 1 << 14)}
    edges = [0, 5, 6, 30, 31, 49, 50]
    assert got[4] == got[1 << 14] == [(0, 0, 0.0), (1, 0, 6.0), (1, 1, 39.0), *((2, k, float(sum(range(a, b)))) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))]


def test_medians_and_rises_of_tall_samples(spark):
    rng = np.random.default_rng(16)
    signals = [rng.normal(size=n) for n in (1, 2, 30)]
    arrays = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)], "clip_id long, y array<double>").select("clip_id", temporal.median_filter("y", 7).alias("m"), temporal.rises("y").alias("r")).collect()
    for made, name in ((temporal.median_filter_tall(tall(spark, *signals), 7), "m"), (temporal.rises_tall(tall(spark, *signals), 4), "r")):
        got = {(r.clip_id, r.n): r.x for r in made.collect()}
        assert got == {(r.clip_id, n): x for r in arrays for n, x in enumerate(r[name])}


def test_pitch_of_batches_is_that_of_each_frame():
    from wavemill.operators import pitch

    rng = np.random.default_rng(17)
    frames_ = np.concatenate([np.sin(2 * np.pi * rng.uniform(60, 1200, 80)[:, None] * np.arange(400) / 8000), rng.normal(size=(20, 400)), np.zeros((2, 400)), np.ones((1, 400))])
    both = np.stack(pitch.track(frames_, 8000, 65, 1000, 0.1), axis=1)
    assert np.array_equal(both, np.concatenate([np.stack(pitch.track(v[None], 8000, 65, 1000, 0.1), axis=1) for v in frames_]))
    for v, (f, c) in zip(frames_, both, strict=True):
        size = 400 - 124 - 1
        d = np.array([((v[:size] - v[lag : lag + size]) ** 2).sum() for lag in range(125)])
        s = np.cumsum(d[1:])
        d = np.r_[1, np.where(s > 0, d[1:] * np.arange(1, 125) / np.where(s > 0, s, 1), 1.0)]
        lag = next((k for k in range(8, 124) if d[k] < 0.1 and d[k] <= d[k + 1] and d[k] <= d[k - 1]), None)
        if lag is None:
            lag = 8 + int(d[8:125].argmin())
            lag = lag if d[lag] < 0.5 else None
        want = (0.0, 0.0)
        if lag is not None:
            x, y, z = d[lag - 1], d[lag], d[min(124, lag + 1)]
            at = lag + (0.5 * (x - z) / (x - 2 * y + z) if lag < 124 and abs(x - 2 * y + z) > 1e-10 else 0)
            want = (8000 / at, 1 - d[lag]) if 65 <= 8000 / at <= 1000 else want
        assert np.allclose((f, c), want)


@pytest.mark.parametrize("per", [1, 7, 1 << 14])
def test_differences_and_stacks_by_stretches(spark, per):
    rng = np.random.default_rng(18)
    signals = [rng.normal(size=n) for n in (1, 2, 4, 5, 9, 23, 40)]
    rows = tall(spark, *signals).select("clip_id", F.col("n").alias("t"), F.lit(0).alias("f"), "x")
    slope = lambda t, x: np.polyfit(t, x, 1)[0] if len(t) > 1 else 0.0
    d, c = ({(r.clip_id, r.t): r.dx for r in f(rows, 5, per).collect()} for f in (temporal.delta, temporal.delta_clamped))
    s = {(r.clip_id, r.t): (r.s0, r.s1, r.s2) for r in temporal.stack(rows, 3, 2, "edge", ahead=1, per=per).collect()}
    assert len(d) == len(c) == len(s) == sum(map(len, signals))
    for k, x in enumerate(signals):
        n, at = len(x), np.arange(len(x))
        for t in range(n):
            want = slope(at[:5], x[:5]) if t < 2 else slope(at[-5:], x[-5:]) if t >= n - 2 else sum(i * (x[t + i] - x[t - i]) for i in (1, 2)) / 10
            assert np.isclose(d[k, t], want)
            near = lambda i: x[min(n - 1, max(0, i))]  # noqa: B023, E731
            assert np.isclose(c[k, t], sum(i * (near(t + i) - near(t - i)) for i in (1, 2)) / 10) and s[k, t] == (near(t + 1), near(t - 1), near(t - 3))
