"""Chains that answer one question about a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import events, features, spectral, temporal


def onset_envelope(clips: DataFrame, sr: float, n_fft: int, hop: int, n_mels: int) -> DataFrame:
    """(clip_id, y): mean rise of the log mel spectrum from frame to frame."""
    mel = spectral.top_db(spectral.mel_spectrogram(clips, sr, n_fft, hop, n_mels, pad_mode="reflect"))
    rows = features.flux(mel).select("clip_id", "t", (F.col("flux") / n_mels).alias("x"))
    made = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s_"))
    return made.select("clip_id", F.expr("transform(s_, s -> s.x)").alias("y"))


def onsets(clips: DataFrame, sr: float, n_fft: int, hop: int, n_mels: int, **peaks) -> DataFrame:
    """(clip_id, t, time_s) of note onsets."""
    env = onset_envelope(clips, sr, n_fft, hop, n_mels).withColumn("p_", events.pick_peaks("y", **peaks))
    return env.select("clip_id", F.explode("p_").alias("t")).withColumn("time_s", F.col("t") * hop / sr)


def track_beats(clips: DataFrame, sr: float, n_fft: int, hop: int, n_mels: int) -> DataFrame:
    """(clip_id, bpm, beats in seconds)."""
    env = onset_envelope(clips, sr, n_fft, hop, n_mels)
    fps = sr / hop
    paced = env.join(temporal.tempo(env, fps), "clip_id").withColumn("period_", F.when(F.col("bpm") > 0, (60 * fps / F.col("bpm")).cast("int")).otherwise(0))
    walked = paced.withColumn("b_", temporal.beats(paced, "period_"))
    return walked.select("clip_id", "bpm", F.expr(f"transform(b_, b -> b * {hop / sr!r}D)").alias("beats"))


def voice_scores(clips: DataFrame, length: int, hop: int, method: str) -> DataFrame:
    """(clip_id, t, score) of frames by their level (energy), zero crossings (zcr) or evenness of spectrum (spectral)."""
    from wavemill.operators.frames import frame

    if method == "spectral":
        return spectral.magnitude_frames(clips, length, hop, center=False).select("clip_id", "t", F.greatest(F.lit(0.0), 1 - features.flatness()).alias("score"))
    frames = frame(clips, length, hop)
    if method == "energy":
        return events.energy_activity(frames)
    if method != "zcr":
        raise ValueError(f"no method {method!r}")
    return frames.select("clip_id", "t", F.greatest(F.lit(0.0), 1 - features.zero_crossing_rate()).alias("score"))


def voice_activity(clips: DataFrame, length: int, hop: int, threshold: float = 0.5, min_speech: int = 3, min_silence: int = 5, method: str = "combined", weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(clip_id, seg_id, start, end, score): segments of frames judged by one of the scores, or by all with the weights of energy, zcr and spectral."""
    if method == "combined":
        score = events.combined_activity([(voice_scores(clips, length, hop, m), w) for m, w in zip(("energy", "zcr", "spectral"), weights, strict=True)])
    else:
        score = voice_scores(clips, length, hop, method)
    active = events.smooth_activity(score.withColumn("active", F.col("score") > threshold), min_speech, min_silence)
    return events.segments(active, "active", "score")


def separate(clips: DataFrame, n_fft: int, hop: int) -> tuple[DataFrame, DataFrame]:
    """Harmonic and percussive signals, (clip_id, n, x) each."""
    from wavemill.operators.decompose import hpss_frames

    spectra = spectral.stft(clips, n_fft, hop)
    joined = spectra.join(hpss_frames(spectral.magnitude(spectra)), ["clip_id", "t"])
    out = []
    for part in ("harmonic", "percussive"):
        kept = joined.select("clip_id", "t", F.expr(f"zip_with(re, {part}, (a, b) -> a * b)").alias("re"), F.expr(f"zip_with(im, {part}, (a, b) -> a * b)").alias("im"))
        out.append(spectral.istft(kept, n_fft, hop))
    return out[0], out[1]
