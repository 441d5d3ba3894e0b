"""Operators against plain numpy, and their behaviour at the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import units
from wavemill.operators import augment, decompose, events, features, frames, pitch, recurrent, similarity, spectral, temporal


def clips(spark, *ys):
    return spark.createDataFrame([(k, [float(v) for v in y]) for k, y in enumerate(ys)], "clip_id long, y array<double>")


EDGES = [[], [1.0], [0.5] * 15, [0.5] * 16, list(range(17)), [0.0] * 40, [1.0] * 40, [0.0] * 20 + [1.0] + [0.0] * 19, [1e6] * 40, [1e-12] * 40]


def test_stft_of_edge_signals(spark):
    got = {(r.clip_id, r.t): np.array(r.re) + 1j * np.array(r.im) for r in spectral.stft(clips(spark, *EDGES), 16, 4).collect()}
    w = np.array(spectral.window_values("hann", 16))
    want = {}
    for k, y in enumerate(EDGES):
        if y:
            p = np.pad(np.array(y, dtype=float), 8)
            for t in range(1 + (len(p) - 16) // 4):
                want[k, t] = np.fft.rfft(p[t * 4 : t * 4 + 16] * w)
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9 * (1 + abs(want[k]).max())) for k in want)


def test_short_window_is_left_aligned(spark):
    y = np.arange(16.0)
    got = spectral.stft(clips(spark, y), 16, 4, win_length=8, center=False).first()
    w = np.zeros(16)
    w[:8] = spectral.window_values("hann", 8)
    assert np.allclose(got.re, np.fft.rfft(y * w).real)


def test_framing_tall_and_wide_agree(spark):
    c = clips(spark, np.sin(np.arange(100)), np.arange(20))
    a = {(r.clip_id, r.t): r.v for r in frames.frame(c, 16, 5).collect()}
    b = {(r.clip_id, r.t): r.v for r in frames.frame_tall(frames.tall(c), 16, 5).collect()}
    assert a == b and len(a) == 17 + 1


@pytest.mark.parametrize("style", ["slaney", "htk", "kaldi"])
def test_filterbank_join_and_matrix_agree(spark, style):
    w = spectral.mel_weights(6, 32, 8000, style=style)
    p = spectral.power(spectral.stft(clips(spark, np.sin(np.arange(200))), 32, 8))
    a = {(r.t, m): x for r in spectral.apply_filterbank(p, w).collect() for m, x in enumerate(r.v)}
    b = {(r.t, r.m): r.value for r in spectral.apply_filterbank_join(p, w).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in b) and all(abs(a[k]) < 1e-12 for k in set(a) - set(b))


def test_top_db_and_cepstrum(spark):
    mel = spark.createDataFrame([(0, 0, [1.0, 1e-12]), (0, 1, [100.0, 1.0])], "clip_id long, t int, v array<double>")
    assert [r.v for r in spectral.top_db(mel, 30.0).orderBy("t").collect()] == [[0.0, -10.0], [20.0, 0.0]]
    m = spectral.dct_matrix(8, 8)
    assert np.allclose(m @ m.T, np.eye(8))


def test_units_round_trip(spark):
    row = spark.range(1).select(*(units.mel_to_hz(units.hz_to_mel(F.lit(f), h), h).alias(f"{f:.0f}{h}") for f in (0.0, 440.0, 5000.0) for h in (True, False))).first()
    assert np.allclose(list(row), [0, 0, 440, 440, 5000, 5000])
    names = spark.createDataFrame([("A4",), ("c#3",), ("Bb2",), ("E",), ("x",)], "n string").select(units.note_to_hz(F.col("n")).alias("f")).collect()
    assert np.allclose([r.f for r in names], [440, 138.5913, 116.5409, 329.6276, 32.70], atol=1e-3)
    assert spark.range(1).select(units.hz_to_note(F.lit(0.0)), units.hz_to_note(F.lit(442.0))).first()[:] == ("-", "A4")


def test_peaks_backtrack_and_silence(spark):
    y = [0, 0, 1, 0, 0, 0.9, 0.95, 0.2, 0, 0, 0.8, 0]
    rows = clips(spark, y, [], [0.0] * 12).withColumn("p", events.pick_peaks("y", wait=3)).withColumn("b", events.backtrack("y", "p", 3)).orderBy("clip_id").collect()
    assert rows[0].p == [2, 6, 10] and rows[0].b == [1, 4, 9] and rows[1].p == [] and rows[2].p == []
    sig = np.r_[np.zeros(40), np.ones(40), np.zeros(40), np.ones(20)]
    c = clips(spark, sig)
    cut = events.split_silence(frames.frame(c, 8, 4), c.select("clip_id", F.size("y").alias("n_samples")), 8, 4, 20).orderBy("start").collect()
    assert [(r.start, r.end) for r in cut] == [(36, 84), (116, 140)]


def test_pitch_of_tones(spark):
    sr = 8000
    c = clips(spark, *(np.sin(2 * np.pi * f * np.arange(4000) / sr) for f in (110, 220, 440)), [0.0] * 4000, [1.0] * 10)
    got = pitch.pitches(c, sr, 1024, 256, 65, 1000, padded=False).groupBy("clip_id").agg(F.median("pitch").alias("p"), F.median("confidence").alias("c")).orderBy("clip_id").collect()
    assert np.allclose([r.p for r in got[:3]], [110, 220, 440], rtol=0.01) and all(r.c > 0.9 for r in got[:3]) and len(got) == 4


def test_recurrent_layers_match_a_loop(spark):
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=(5, 4)), rng.normal(size=(3, 4)), np.zeros((0, 4))]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(xs)], "seq_id long, x array<array<double>>")
    for kind in ("lstm", "gru"):
        w = [recurrent.random_weights(kind, 4, 3, s) for s in (1, 2)]
        got = {r.seq_id: np.array(r.out) for r in recurrent.run_layers(rows, [w], kind).collect()}
        assert len(got[2]) == 0
        for k in (0, 1):
            for d in (0, 1):
                h, c = np.zeros(3), np.zeros(3)
                for t in range(len(xs[k]))[:: -1 if d else 1]:
                    if kind == "lstm":
                        g = w[d]["ih"] @ xs[k][t] + w[d]["bih"] + w[d]["hh"] @ h + w[d]["bhh"]
                        i, f, z, o = np.split(g, 4)
                        c = c / (1 + np.exp(-f)) + np.tanh(z) / (1 + np.exp(-i))
                        h = np.tanh(c) / (1 + np.exp(-o))
                    else:
                        a, b = w[d]["ih"] @ xs[k][t] + w[d]["bih"], w[d]["hh"] @ h + w[d]["bhh"]
                        r, z = (1 / (1 + np.exp(-(a[s] + b[s]))) for s in (slice(0, 3), slice(3, 6)))
                        h = (1 - z) * np.tanh(a[6:] + r * b[6:]) + z * h
                    assert np.allclose(got[k][t][3 * d : 3 * d + 3], h)


def test_factors_rebuild_low_rank_frames(spark):
    rng = np.random.default_rng(5)
    v = rng.random((60, 2)) @ rng.random((2, 9))
    rows = spark.createDataFrame([(0, t, x.tolist()) for t, x in enumerate(v)], "clip_id long, t int, v array<double>")
    found = decompose.nmf(rows, 9, 2, 60, tolerance=0)
    back = np.array([r.v for r in decompose.nmf_reconstruct(found.activations, found.basis).orderBy("t").collect()])
    assert np.linalg.norm(back - v) / np.linalg.norm(v) < 0.02


def test_hpss_splits_lines(spark):
    m = np.zeros((20, 20))
    m[:, 5] = 1
    m[10, :] = 1
    rows = spark.createDataFrame([(0, t, x.tolist()) for t, x in enumerate(m)], "clip_id long, t int, v array<double>")
    got = {(r.t, r.f): r for r in decompose.hpss(rows, 7, 7).collect()}
    assert got[2, 5].harmonic > 0.99 and got[10, 15].percussive > 0.99


def test_stretch_keeps_pitch_and_changes_length(spark):
    sr = 4000
    c = clips(spark, np.sin(2 * np.pi * 250 * np.arange(4096) / sr))
    y = np.array([r.x for r in spectral.time_stretch(c, 2.0, 256, 64).orderBy("n").collect()])
    assert 1800 < len(y) < 2300
    assert abs(np.abs(np.fft.rfft(y[200:1224])).argmax() * sr / 1024 - 250) < 8


def test_beats_and_tempo(spark):
    env = np.zeros(200)
    env[5::10] = 1
    rows = clips(spark, env, np.zeros(50)).withColumn("p", F.lit(10)).withColumn("b", temporal.beats(None, "p"))
    got = rows.orderBy("clip_id").collect()
    assert got[0].b[:3] == [5, 15, 25] and len(got[0].b) == 20
    bpm = {r.clip_id: r.bpm for r in temporal.tempo(rows.select("clip_id", "y"), 20.0).collect()}
    assert abs(bpm[0] - 120) < 1e-9 and bpm[1] == 0


def test_augmentation_is_seeded(spark):
    c = clips(spark, np.sin(np.arange(2000) / 5))
    a, b, d = (np.array(c.select(augment.add_noise("y", "clip_id", 10.0, seed=s).alias("z")).first().z) for s in (1, 1, 2))
    assert (a == b).all() and (a != d).any()
    y = np.array(c.first().y)
    assert abs(10 * np.log10((y**2).sum() / ((a - y) ** 2).sum()) - 10) < 1e-6
    w = c.select(F.expr(f"transform(sequence(0, 999), i -> {augment.white()})").alias("y"))
    assert max(abs(v) for v in w.first().y) <= 1 and len(w.select(augment.pink("y").alias("p")).first().p) == 1000


def test_normalise_constant_and_unit(spark):
    rows = spark.createDataFrame([(0, t, [1.0, float(t)]) for t in range(4)], "clip_id long, t int, v array<double>")
    mid = {(r.t, r.f): r.x for r in features.min_max(rows).collect()}
    assert mid[0, 0] == 0.5 and mid[3, 1] == 1.0
    assert np.allclose([math.hypot(*r.v) for r in rows.select(features.unit_frames().alias("v")).collect()], 1)


def test_modes_of_synchronise(spark):
    rows = spark.createDataFrame([(0, t, [float(t)]) for t in range(6)], "clip_id long, t int, v array<double>")
    bounds = spark.createDataFrame([(0, 2)], "clip_id long, b int")
    got = {how: [r.v[0] for r in similarity.synchronise(rows, bounds, how).orderBy("seg").collect()] for how in ("mean", "median", "max", "min", "sum", "first", "last")}
    assert got == {"mean": [0.5, 3.5], "median": [0.5, 3.5], "max": [1, 5], "min": [0, 2], "sum": [1, 14], "first": [0, 2], "last": [1, 5]}


def test_deemphasis_counts_as_it_collects(spark, small):
    import __spark_entry__

    rows = __spark_entry__.queries()["deemphasis_round_trip"](spark, small)
    assert rows.count() == len(rows.toPandas()) == spark.read.parquet(f"{small}/events.parquet").count()


def test_deemphasis_undoes_preemphasis(spark):
    there = clips(spark, *EDGES).select("clip_id", temporal.preemphasis().alias("z"), "y")
    back = {r.clip_id: (r.y, r.back) for r in temporal.deemphasis(there, "z", "back").collect()}
    assert all(np.allclose(*both, rtol=1e-9) for k, both in back.items() if len(EDGES[k]) > 1)
    none = spark.createDataFrame([(1, None)], "clip_id long, y array<double>")
    assert temporal.deemphasis(none).first().y is None


def plain_metronome(bpm, sr, n, freq, per_bar, click, most):
    y, length = np.zeros(n), math.floor(click * sr)
    for b in range(most if bpm else 0):
        a = math.floor(b * 60 / bpm * sr)
        for i in range(max(0, a), min(n, a + length)):
            y[i] += (1 if b % per_bar == 0 else 0.7) * (1 - (i - a) / length) * math.sin(2 * math.pi * freq * (1 if b % per_bar else 2) * (i - a) / sr)
    return y


@pytest.mark.parametrize("some", [1, 30, 1 << 18])
@pytest.mark.parametrize("most", [None, 5])
def test_metronome_by_pieces_of_clicks(monkeypatch, some, most):
    monkeypatch.setattr(augment, "SOME", some)
    bpm, sizes = np.array([120.0, 1100.0, np.nan, 3000.0, 0.0, 90.0, -700.0, 61.5]), np.array([256, 100, 50, 64, 10, 0, 40, 1])
    got = augment._beats(bpm, np.full(8, 200.0), np.full(8, 30.0), sizes, 3, 0.1, most)
    want = [plain_metronome(0 if np.isnan(b) else b, 200.0, n, 30.0, 3, 0.1, most or 60) for b, n in zip(bpm, sizes, strict=True)]
    assert np.allclose(got, np.concatenate(want), rtol=1e-9, atol=1e-12)


def test_metronome_takes_all_parameters_from_rows(spark):
    rows = spark.createDataFrame([(7, 100.0, 200.0, 20.0, 300), (7, 240.0, 400.0, 35.0, 90), (8, 60.0, 10.0, 3.0, 30), (9, None, 200.0, 20.0, 3), (None, 100.0, 100.0, 9.0, 0)], "k int, tempo double, rate double, f double, n int")
    made = augment.metronome(rows, "k", "tempo", "rate", "n", "f").collect()
    want = [(k, plain_metronome(tempo, rate, n, f, 4, 0.05, 60) if tempo else np.zeros(n)) for k, tempo, rate, f, n in rows.collect()]
    for k, y in want:
        assert any(r.clip_id == k and len(r.y) == len(y) and np.allclose(r.y, y, rtol=1e-9, atol=1e-12) for r in made)
    assert len(made) == len(want)


def test_generated_metronome_of_odd_sizes_by_many_tasks(spark, tmp_path, same):
    """One file of parts is worked on by several tasks; any size gives the rows of the SQL."""
    import duckdb

    import __spark_entry__

    sizes = [None, 0, 1, 50, 88, 89, 100, 500, -4, -10, -1000]
    spark.createDataFrame([(k, s, 1.0) for k, s in enumerate(sizes)], "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["generated_metronome"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    same(got.toPandas(), con.sql(__spark_entry__.oracle_sql()["generated_metronome"]).df())
    assert got.select(F.spark_partition_id()).distinct().count() > 1
