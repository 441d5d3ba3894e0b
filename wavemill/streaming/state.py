"""Stateful operators for streams of sample chunks (clip_id, seq, y, last) and of frames (clip_id, t, v, last).

A clip's state is what the next row still needs, and the rows that came before their turn: chunks are numbered from 0 without gaps, and results
come out the same in whatever order and batches they arrive. A row that came before is a repeat and is left out. State goes with a clip's
last row, or, with ``idle`` milliseconds given, when nothing has come for that long: then what waits is worked off in its order, over the gaps, and
the clip ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_available(rows: DataFrame, make) -> DataFrame:
    """Put ``rows`` through a stream: written to the shared folder, read back as a stream, until all is done.

    ``make`` maps the stream to its result; the result is a table in the same folder.
    """
    import uuid

    from wavemill.operators.lineage import shared_folder

    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    out = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


#: Of the order: the next number, and what waits for its turn.
ORDER = "next long, numbers array<long>, bodies array<array<double>>, lasts array<boolean>"


def timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


class Turns:
    """The rows of a clip in their order, from batches that bring them in any."""

    def __init__(self, held: tuple | None):
        self.next, numbers, bodies, lasts = held or (0, [], [], [])
        self.waiting = {int(n): (np.asarray(b, dtype=float), bool(e)) for n, b, e in zip(numbers, bodies, lasts, strict=True)}

    def add(self, parts: Iterator[pd.DataFrame], number: str, body: str) -> None:
        for part in parts:
            ends = part["last"] if "last" in part else [False] * len(part)
            for n, b, e in zip(part[number], part[body], ends, strict=True):
                if n >= self.next:
                    self.waiting[int(n)] = np.asarray(b, dtype=float), bool(e)

    def ready(self, all_of_them: bool = False) -> Iterator[tuple[int, np.ndarray, bool]]:
        """What can go now, with whether it is the clip's last; ``all_of_them`` over gaps."""
        while self.waiting:
            n = min(self.waiting) if all_of_them else self.next
            if n not in self.waiting:
                return
            body, last = self.waiting.pop(n)
            self.next = n + 1
            yield n, body, last or (all_of_them and not self.waiting)
            if last:
                self.waiting.clear()

    def kept(self) -> tuple:
        order = sorted(self.waiting)
        return self.next, order, [self.waiting[n][0].tolist() for n in order], [self.waiting[n][1] for n in order]


def keep(state: GroupState, value: tuple, idle: int | None) -> None:
    state.update(value)
    if idle is not None:
        state.setTimeoutDuration(idle)


def stream_frames(chunks: DataFrame, length: int, hop: int, pad_end: bool = True, idle: int | None = None) -> DataFrame:
    """(clip_id, t, v): frames without centring as soon as their samples are there.

    A chunk with last = true ends the clip: with ``pad_end`` what is left becomes one frame filled up with zeros, and
    the state goes.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, t, *order = (np.array(state.get[0]), *state.get[1:]) if state.exists else (np.zeros(0), 0)
        turns, over = Turns(tuple(order) or None), state.hasTimedOut
        turns.add(parts, "seq", "y")
        out = []
        for _, y, last in turns.ready(over):
            held = np.concatenate([held, y])
            while len(held) >= length:
                out.append((key[0], t, held[:length].tolist()))
                held, t = held[hop:], t + 1
            over = over or last
        if over:
            if pad_end and len(held):
                out.append((key[0], t, np.concatenate([held, np.zeros(length - len(held))]).tolist()))
            if state.exists:
                state.remove()
        else:
            keep(state, (held.tolist(), t, *turns.kept()), idle)
        yield pd.DataFrame(out, columns=["clip_id", "t", "v"])

    return chunks.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, t int, v array<double>", f"held array<double>, t int, {ORDER}", "append", timeout(idle))


def stream_overlap_add(frames: DataFrame, n_fft: int, hop: int, window: list[float], idle: int | None = None) -> DataFrame:
    """(clip_id, start, y): samples that no later frame touches, from frames (clip_id, t, v, last) of inverse spectra."""
    w = np.array(window)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, sums, weight, *order = (state.get[0], np.array(state.get[1]), np.array(state.get[2]), *state.get[3:]) if state.exists else (0, np.zeros(0), np.zeros(0))
        turns, over, ready = Turns(tuple(order) or None), state.hasTimedOut, 0
        turns.add(parts, "t", "v")
        for t, v, last in turns.ready(over):
            at = t * hop - done
            if len(sums) < at + n_fft:
                sums, weight = (np.concatenate([x, np.zeros(at + n_fft - len(x))]) for x in (sums, weight))
            sums[at : at + n_fft] += v * w
            weight[at : at + n_fft] += w * w
            ready, over = (t + 1) * hop - done, over or last
        ready = len(sums) if over else max(0, ready)
        out = [(key[0], done, (sums[:ready] / np.maximum(weight[:ready], 1e-10)).tolist())] if ready else []
        if over:
            if state.exists:
                state.remove()
        else:
            keep(state, (done + ready, sums[ready:].tolist(), weight[ready:].tolist(), *turns.kept()), idle)
        yield pd.DataFrame(out, columns=["clip_id", "start", "y"])

    return frames.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, start long, y array<double>", f"done long, sums array<double>, weight array<double>, {ORDER}", "append", timeout(idle))


def stream_normalise(frames: DataFrame, least: int = 10, idle: int | None = None) -> DataFrame:
    """(clip_id, t, v): frames less the running mean over the running deviation, as they are until ``least`` have come.

    State goes with a frame whose last is true, where the stream has that column, or after ``idle`` milliseconds.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, q, *order = (state.get[0], np.array(state.get[1]), np.array(state.get[2]), *state.get[3:]) if state.exists else (0, np.zeros(0), np.zeros(0))
        turns, over, out = Turns(tuple(order) or None), state.hasTimedOut, []
        turns.add(parts, "t", "v")
        for t, x, last in turns.ready(over):
            s, q, n = (s + x, q + x * x, n + 1) if n else (x.copy(), x * x, 1)
            if n >= least:
                mean = s / n
                x = (x - mean) / np.sqrt(np.maximum(q / n - mean * mean, 1e-10))
            out.append((key[0], t, x.tolist()))
            over = over or last
        if over:
            if state.exists:
                state.remove()
        else:
            keep(state, (n, s.tolist(), q.tolist(), *turns.kept()), idle)
        yield pd.DataFrame(out, columns=["clip_id", "t", "v"])

    return frames.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, t int, v array<double>", f"n long, s array<double>, q array<double>, {ORDER}", "append", timeout(idle))


def stream_features(chunks: DataFrame, n_fft: int, hop: int, weights: np.ndarray, log: bool = True) -> DataFrame:
    """(clip_id, t, v): log filterbank energies of a stream; every step after framing is without state."""
    from pyspark.sql import functions as F

    from wavemill.operators.frames import apply_window
    from wavemill.operators.spectral import apply_filterbank, map_frames

    frames = apply_window(stream_frames(chunks, n_fft, hop), "hann", None, n_fft)
    spectra = map_frames(frames, "v", ["v"], lambda v: (np.abs(np.fft.rfft(v, axis=1)) ** 2,))
    bands = apply_filterbank(spectra, weights)
    return bands.withColumn("v", F.expr("transform(v, x -> 10 * log10(greatest(x, 1e-10D)))")) if log else bands


def stream_pitch(chunks: DataFrame, sr: float, length: int, hop: int, f_min: float, f_max: float, threshold: float = 0.1) -> DataFrame:
    """(clip_id, t, pitch, confidence) of a stream."""
    from pyspark.sql import functions as F

    from wavemill.operators.pitch import track
    from wavemill.operators.spectral import map_frames

    found = map_frames(stream_frames(chunks, length, hop, pad_end=False), "v", ["p_"], lambda v: (np.stack(track(v, sr, f_min, f_max, threshold), axis=1),))
    return found.select("clip_id", "t", F.col("p_")[0].alias("pitch"), F.col("p_")[1].alias("confidence"))
