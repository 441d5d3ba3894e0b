import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import frames, recurrent, spectral
from wavemill.sources import audio
from wavemill.streaming import state


def test_audio_files_round_trip(spark, tmp_path):
    y = [np.sin(np.arange(50) / 7).tolist(), np.cos(np.arange(50) / 7).tolist()]
    rows = spark.createDataFrame([("a.wav", 8000, y)], "name string, sr int, channels array<array<double>>")
    for kind in ("wav", "aiff", "caf"):
        folder = f"file://{tmp_path}/{kind}"
        audio.write_files(audio.with_encoded(rows.withColumn("name", F.lit(f"a.{kind}")), kind), folder)
        back = audio.read_audio(spark, folder).first()
        assert (back.sr, back.n_channels, back.n_frames, back.start) == (8000, 2, 50, 0) and np.abs(np.array(back.channels) - y).max() < 1 / 32000
        head = audio.read_audio(spark, folder, samples=False)
        assert head.columns == ["path", "sr", "n_channels", "n_frames"] and head.first()[1:] == (8000, 2, 50)
    assert np.allclose(spark.createDataFrame([(y,)], "channels array<array<double>>").select(frames.mono().alias("m")).first().m, np.mean(y, axis=0))


def test_audio_is_read_by_ranges(spark, tmp_path):
    """Ranges that cut frames anywhere, rows of some frames, small files together in one task; every frame once."""
    rng = np.random.default_rng(1)
    signals = {f"{k}.{kind}": rng.uniform(-1, 1, (c, n)) for k, (kind, c, n) in enumerate([("wav", 1, 1000), ("wav", 3, 777), ("aiff", 2, 501), ("caf", 2, 640), ("wav", 1, 0), ("caf", 1, 1)])}
    for name, y in signals.items():
        (tmp_path / name).write_bytes(audio.encode(y, 8000, name.split(".")[1]))
    for size, chunk in ((101, 50), (64, 7), (4000, 1 << 19), (1 << 20, 300)):
        rows = audio.read_audio(spark, f"file://{tmp_path}", range_bytes=size, chunk=chunk)
        assert size > 200 or rows.rdd.getNumPartitions() > 20
        got: dict[str, list] = {}
        for r in rows.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.start, np.array(r.channels)))
        for name, y in signals.items():
            parts = sorted(got[name], key=lambda p: p[0])
            assert [p[0] for p in parts] == np.cumsum([0, *(p[1].shape[1] for p in parts)])[:-1].tolist()
            assert np.concatenate([p[1] for p in parts], axis=1).shape == y.shape and np.abs(np.concatenate([p[1] for p in parts], axis=1) - y).max(initial=0) < 1 / 32000
    assert audio.tall_audio(audio.read_audio(spark, f"file://{tmp_path}/1.wav")).count() == 3 * 777


def test_headers_of_odd_files():
    x = np.array([[0.5, -0.25]])
    pcm24 = b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x[0])
    fmt = lambda code, bits, n=1: struct.pack("<4sIHHIIHH", b"fmt ", 16, code, n, 8000, 8000 * n * bits // 8, n * bits // 8, bits)
    junk = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    files = {
        "24 bit, a chunk before": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + junk + fmt(1, 24) + struct.pack("<4sI", b"data", 6) + pcm24,
        "bytes": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt(1, 8) + struct.pack("<4sI", b"data", 2) + bytes([191, 96]),
        "floats": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt(3, 64) + struct.pack("<4sI", b"data", 16) + x.astype("<f8").tobytes(),
        "over 4 GB by its header": b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + struct.pack("<4sIQQQI", b"ds64", 28, 0, 4, 2, 0) + fmt(1, 16) + struct.pack("<4sI", b"data", 0xFFFFFFFF) + (x * 32767).astype("<i2").tobytes(),
        "caf without a length": b"caff" + struct.pack(">HH", 1, 0) + struct.pack(">4sq", b"desc", 32) + struct.pack(">d4sIIIII", 8000.0, b"lpcm", 0, 2, 1, 1, 16) + struct.pack(">4sqI", b"data", -1, 0) + (x * 32767).astype(">i2").tobytes(),
    }
    for name, data in files.items():
        sr, y = audio.decode(data)
        assert sr == 8000 and np.abs(y - x).max() < 0.01, name
    for data in (b"", b"RIFFxxxxWAVE", b"ID3 and so on, not audio", files["bytes"].replace(struct.pack("<H", 1), struct.pack("<H", 85), 1)):
        with pytest.raises(ValueError):
            audio.decode(data)


def test_raw_samples_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("x.bin", [0.5, -1.25, 3.0])], "name string, y array<double>")
    audio.write_files(audio.with_raw(rows), f"file://{tmp_path}/raw")
    assert audio.read_raw(spark, f"file://{tmp_path}/raw", 3).first().y == [0.5, -1.25, 3.0]
    report = spark.createDataFrame([("stft", 1.5)], "name string, mean double")
    audio.write_report(report, f"{tmp_path}/r", "json")
    assert audio.read_baseline(spark, f"{tmp_path}/r").first().name == "stft"
    assert [r.line for r in audio.markdown(report).collect()] == ["| name | mean |", "|---|---|", "| stft | 1.5 |"]


def streamed(spark, rows, schema, make, tmp_path, name):
    """Feed rows file by file, one a batch, and gather what comes out."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{name}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.sql(f"select * from {name}").collect()


def test_stream_frames_equal_batch(spark, tmp_path):
    y = np.sin(np.arange(70)).tolist()
    parts = [[(1, 0, y[:13], False)], [(1, 1, y[13:50], False)], [(1, 2, y[50:], True)]]
    got = streamed(spark, parts, "clip_id long, seq int, y array<double>, last boolean", lambda s: state.stream_frames(s, 16, 8), tmp_path, "frames_out")
    got = {r.t: r.v for r in got}
    batch = {r.t: r.v for r in frames.frame(spark.createDataFrame([(1, y)], "clip_id long, y array<double>"), 16, 8).collect()}
    assert {t: got[t] for t in batch} == batch and len(got) == len(batch) + 1 and got[len(batch)][-1] == 0.0


def test_stream_overlap_add_inverts(spark, tmp_path):
    y = np.sin(np.arange(64))
    w = spectral.window_values("hann", 16)
    parts = [[(1, t, (y[t * 4 : t * 4 + 16] * w).tolist(), t == 12) for t in ts] for ts in (range(0, 5), range(5, 13))]
    got = streamed(spark, parts, "clip_id long, t int, v array<double>, last boolean", lambda s: state.stream_overlap_add(s, 16, 4, w), tmp_path, "overlap_out")
    out = np.concatenate([np.array(r.y) for r in sorted(got, key=lambda r: r.start)])
    assert len(out) == 64 and np.allclose(out[1:63], y[1:63], atol=1e-8)


def test_stream_normalise_waits(spark, tmp_path):
    parts = [[(1, t, [float(t)]) for t in range(6)], [(1, t, [float(t)]) for t in range(6, 12)]]
    got = streamed(spark, parts, "clip_id long, t int, v array<double>", lambda s: state.stream_normalise(s, 10), tmp_path, "normal_out")
    v = {r.t: r.v[0] for r in got}
    assert [v[t] for t in range(9)] == list(range(9)) and np.isclose(v[11], (11 - 5.5) / np.std(np.arange(12)))


def test_streams_in_any_order(spark, tmp_path):
    """Chunks that come before their turn wait over batches, repeats are left out, and nothing of an ended clip is kept."""
    y = np.sin(np.arange(90)).tolist()
    cuts = [0, 13, 20, 50, 61, 90]
    chunk = lambda k: (1, k, y[cuts[k] : cuts[k + 1]], k == 4)
    parts = [[chunk(2), chunk(0)], [chunk(4)], [chunk(0), chunk(3)], [chunk(1)]]
    got = {r.t: r.v for r in streamed(spark, parts, "clip_id long, seq int, y array<double>, last boolean", lambda s: state.stream_frames(s, 16, 8), tmp_path, "any_order_out")}
    batch = {r.t: r.v for r in frames.frame(spark.createDataFrame([(1, y)], "clip_id long, y array<double>"), 16, 8).collect()}
    assert {t: got[t] for t in batch} == batch and len(got) == len(batch) + 1
    w = spectral.window_values("hann", 16)
    x = np.sin(np.arange(64))
    rows = [[(1, t, (x[t * 4 : t * 4 + 16] * w).tolist(), t == 12) for t in ts] for ts in ([12, 3, 1], [0, 5, 1], [2, 4, 7, 8, 9, 10, 11], [6])]
    out = streamed(spark, rows, "clip_id long, t int, v array<double>, last boolean", lambda s: state.stream_overlap_add(s, 16, 4, w), tmp_path, "any_overlap_out")
    assert np.allclose(np.concatenate([np.array(r.y) for r in sorted(out, key=lambda r: r.start)])[1:63], x[1:63], atol=1e-8)
    rows = [[(1, t, [float(t)], t == 11) for t in ts] for ts in ([11, 4, 3], [0, 1, 2, 2], [5, 6, 7, 8, 9, 10])]
    v = {r.t: r.v[0] for r in streamed(spark, rows, "clip_id long, t int, v array<double>, last boolean", lambda s: state.stream_normalise(s, 10), tmp_path, "any_normal_out")}
    assert [v[t] for t in range(9)] == list(range(9)) and np.isclose(v[11], (11 - 5.5) / np.std(np.arange(12)))


def test_idle_state_goes(spark, tmp_path):
    """Clips without a last chunk end when nothing has come for a while: what waits comes out, over the gap, and no state is left."""
    schema = "clip_id long, seq int, y array<double>, last boolean"
    rows = [(k, s, [float(s)] * 10, False) for k in range(5) for s in (0, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    made = state.stream_frames(spark.readStream.schema(schema).json(f"{tmp_path}/in"), 8, 8, idle=1500)
    query = made.writeStream.format("memory").queryName("idle_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        sizes = []
        for _ in range(120):
            time.sleep(0.5)
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            if 5 in sizes and sizes[-1] == 0:
                break
        assert max(sizes) == 5 and sizes[-1] == 0
        got = spark.sql("select * from idle_out").collect()
        assert sorted({(r.clip_id, r.t) for r in got}) == [(k, t) for k in range(5) for t in range(3)] and next(r.v for r in got if (r.clip_id, r.t) == (0, 1)) == [0.0] * 2 + [2.0] * 6
    finally:
        query.stop()


def test_weights_come_back_whole(spark, tmp_path):
    made = [[recurrent.random_weights("gru", 8, 4, s) for s in (42, 43)]]
    for bits in (32, 64):
        folder = f"file://{tmp_path}/weights-{bits}"
        audio.write_files(audio.with_raw(recurrent.weight_files(spark, made), bits=bits), folder)
        loaded = recurrent.load_weights(spark, folder, 1, bidirectional=True, bits=bits)
        for want, got in zip(made[0], loaded[0], strict=True):
            assert all((want[k].astype(f"f{bits // 8}") == got[k]).all() for k in want)
    # What a query makes of them is then the same to the last digit that its SQL keeps.
    import __spark_entry__

    rows = __spark_entry__.queries()["layers_from_files"](spark, "/root/testdata/sf0.01").where("seq_id = 452 and i = 16").collect()
    assert [r.x for r in rows] == [-0.1906]
