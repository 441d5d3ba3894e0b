"""Clips in blocks with a halo: overlap-add, framing, and iterations between signals and spectra.

A block is a stretch of a clip's frames or samples that one task works on, whatever the clip's length. What a block needs of its neighbours,
its halo, is sent to it by the same shuffle that brings its own rows together, so a shuffle carries each frame about once. Iterations take a
halo wide enough for several rounds: every round spoils the outermost frames of the halo, none of the block's own, and blocks meet again
only when the halo is used up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.lineage import cut

#: Samples of a block of a tall clip.
SAMPLES = 1 << 15
#: Values that a task of an iteration holds of each of its arrays.
HELD = 1 << 21


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def rows_of(m: np.ndarray) -> pa.ListArray:
    m = np.ascontiguousarray(m, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def lists_of(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.ascontiguousarray(values, dtype=np.float64)))


def over_groups(rows: DataFrame, keys: list[str], order: str, step: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``step`` over whole groups of ``keys``, sorted by ``order``, many at a time: a table and the places at which its groups begin."""
    numbered = rows.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("r_")).to_numpy() == 1)
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                yield from give(held)
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        yield from give(held)

    def give(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from step(table, np.flatnonzero(table.column("r_").to_numpy() == 1))

    return numbered.mapInArrow(run, schema)


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) and found.num_chunks else found


def typed(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def reaching(t: Column | str, per: int, before: int, after: int) -> Column:
    """The blocks of ``per`` frames that frame t is in, as an own one or in the halo of ``before`` frames ahead of a block and ``after`` behind it."""
    t = F.col(t) if isinstance(t, str) else t
    low = F.greatest(F.lit(0), F.floor((t - after) / per)).cast("int")
    return F.explode(F.sequence(low, F.floor((t + before) / per).cast("int")))


def overlap_add_blocks(frames: DataFrame, n_fft: int, hop: int, w: np.ndarray, trim: int = 0, length: int | None = None, keys: tuple[str, ...] = ("clip_id",), per: int | None = None) -> DataFrame:
    """(keys, n, y): stretches of samples from n on, of frames (keys, t, v) times ``w``, summed where they overlap, over the sum of w squared.

    A block of ``per`` frames gets the last frames before it that reach into it, and of the block behind it only that there is one. Frames are
    numbered without gaps. ``trim`` samples go at both ends, else the last frame's end is the end; ``length`` sets another.
    """
    reach = -(-n_fft // hop) - 1
    per = per or max(64, 16 * reach)
    keys = list(keys)
    own = F.floor(F.col("t") / per).cast("int")
    low = F.when((F.col("t") % per == 0) & (F.col("t") > 0), own - 1).otherwise(own)
    placed = frames.select(*keys, "t", "v", F.explode(F.sequence(low, F.floor((F.col("t") + reach) / per).cast("int"))).alias("b_"))
    placed = placed.withColumn("v", F.when(F.col("b_") >= own, F.col("v")))
    parts, w = reach + 1, np.asarray(w, dtype=float)

    def step(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, b, v = table.column("t").to_numpy(), table.column("b_").to_numpy(), column(table, "v")
        group = np.zeros(len(t), dtype=np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        some = v.is_valid().to_numpy(zero_copy_only=False)
        m = matrix(v.filter(pa.array(some))) * w
        m = np.concatenate([m, np.zeros((len(m), parts * hop - n_fft))], axis=1)
        ww = np.r_[w * w, np.zeros(parts * hop - n_fft)]
        total, weight = np.zeros((len(starts) * per, hop)), np.zeros((len(starts) * per, hop))
        at = (t - b * per)[some]
        for s in range(parts):  # the s-th hop of a frame lies s hops behind its start
            own = (at + s >= 0) & (at + s < per)
            slot = group[some][own] * per + (at + s)[own]
            total[slot] += m[own, s * hop : (s + 1) * hop]
            weight[slot] += ww[s * hop : (s + 1) * hop]
        x = (total / np.maximum(weight, 1e-10)).reshape(len(starts), per * hop)
        first = b[starts].astype(np.int64) * per * hop - trim
        last = np.maximum.reduceat(t, starts).astype(np.int64)
        end = np.full(len(starts), length, dtype=np.int64) if length is not None else last * hop + (0 if trim else n_fft)
        n = first[:, None] + np.arange(per * hop)
        kept = (n >= 0) & (n < end[:, None])
        sizes = kept.sum(axis=1)
        full = np.flatnonzero(sizes)
        if len(full):
            yield pa.RecordBatch.from_arrays([*(column(table, k).take(pa.array(starts[full])) for k in keys), pa.array(np.maximum(first, 0)[full]), lists_of(x[kept], sizes[full])], names=[*keys, "n", "y"])

    return over_groups(placed, [*keys, "b_"], "t", step, f"{typed(frames, keys)}, n long, y array<double>")


def samples_of(blocks: DataFrame, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """(keys, n, x) from blocks (keys, n, y)."""
    return blocks.select(*keys, F.col("n").alias("n0_"), F.posexplode("y").alias("i_", "x")).select(*keys, (F.col("n0_") + F.col("i_")).alias("n"), "x")


def sample_blocks(samples: DataFrame, size: int = SAMPLES) -> DataFrame:
    """(clip_id, n, y): tall samples in blocks of ``size``; a clip's samples are numbered from 0 without gaps."""
    made = samples.groupBy("clip_id", F.floor(F.col("n") / size).alias("b_")).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s_"))
    return made.select("clip_id", (F.col("b_") * size).alias("n"), F.expr("transform(s_, s -> s.x)").alias("y"))


def with_neighbours(blocks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(clip_id, b_, own_, prev_, next_): blocks (clip_id, n, y) of ``size`` samples with the last ``before`` samples ahead of them and the first ``after``
    behind, null where there is no such block. Only these samples are sent to another block."""
    none = F.lit(None).cast("array<double>")
    b = (F.col("n") / size).cast("long")
    parts = [blocks.select("clip_id", b.alias("b_"), F.col("y").alias("own_"), none.alias("prev_"), none.alias("next_"))]
    if before:
        tail = F.expr(f"slice(y, greatest(1, size(y) - {before} + 1), {before})")
        parts.append(blocks.where(F.size("y") == size).select("clip_id", (b + 1).alias("b_"), none.alias("own_"), tail.alias("prev_"), none.alias("next_")))
    if after:
        parts.append(blocks.where("n > 0").select("clip_id", (b - 1).alias("b_"), none.alias("own_"), none.alias("prev_"), F.slice("y", 1, after).alias("next_")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return every.groupBy("clip_id", "b_").agg(first("own_"), first("prev_"), first("next_")).where("own_ is not null")


def cells(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The arrays of row k of a batch of ``with_neighbours``, empty ones for nulls: own, before, after."""
    return [np.asarray(c[k].values) if c[k].is_valid else np.zeros(0) for c in batch.columns[2:5]]


def frames_of(blocks: DataFrame, length: int, hop: int, pad: int = 0, size: int = SAMPLES, mode: str = "constant") -> DataFrame:
    """(clip_id, t, v): frames of blocks (clip_id, n, y) of ``size`` samples, with ``pad`` zeros (or reflected samples) at both ends of a clip.

    A frame is made where its first sample is; a shuffle carries (size + length) / size times the samples. Frames that don't lie inside the
    padded clip are left out.
    """
    if max(length, pad + 1) > size:
        raise ValueError("a frame is longer than a block")
    names, reflect = ["clip_id", "t", "v"], mode == "reflect" and pad > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column(1)[k].as_py()
                y, before, after = cells(batch, k)
                left, right = np.zeros(pad if b == 0 else 0), np.zeros(0 if len(after) == length else pad)
                if reflect:
                    tail = np.concatenate([before, y, after])  # all of a clip that is shorter than its padding
                    left = tail[np.arange(pad, 0, -1) % len(tail)] if len(left) else left
                    right = tail[len(tail) - 1 - np.arange(1, pad + 1) % len(tail)] if len(right) else right
                x = np.concatenate([left, y, after, right])
                start = b * size - (pad if b == 0 else 0)  # where x begins in the clip
                low = max(0, -(-(b * size + pad) // hop)) if b else 0
                high = min((b + 1) * size - 1 + pad, start + len(x) - length + pad) // hop
                if len(y) and high >= low:
                    t = np.arange(low, high + 1)
                    v = np.lib.stride_tricks.sliding_window_view(x, length)[t * hop - pad - start]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(t), k))), pa.array(t.astype(np.int32)), rows_of(v)], names=names)

    return with_neighbours(blocks, size, pad + 1 if reflect else 0, length).mapInArrow(run, f"{typed(blocks, ['clip_id'])}, t int, v array<double>")


def over_frames(frames: DataFrame, per: int, before: int, after: int, work: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` over blocks of ``per`` frames (clip_id, t, v) with ``before`` and ``after`` frames of the clip around them, many of one size at a time.

    work(clip_id of each block, t (blocks, frames), v (blocks, frames, features), the own frames as a slice) gives a batch of the schema, or none.
    Frames are numbered without gaps; where a halo is cut off, the clip ends.
    """
    placed = frames.select("clip_id", "t", "v").withColumn("b_", reaching("t", per, before, after))

    def step(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, b = table.column("t").to_numpy().astype(np.int64), table.column("b_").to_numpy().astype(np.int64)[starts]
        v = matrix(column(table, "v"))
        sizes, offset = np.diff(np.r_[starts, len(t)]), t[starts] - b * per
        alike: dict[tuple[int, int], list[int]] = {}
        for k, key in enumerate(zip(sizes.tolist(), offset.tolist(), strict=True)):
            alike.setdefault(key, []).append(k)
        for (size, first), own in alike.items():
            mine = slice(max(0, -first), min(size, per - first))
            most = max(1, HELD // max(1, size * v.shape[1]))
            for k in range(0, len(own) if mine.start < mine.stop else 0, most):
                at = starts[own[k : k + most]]
                rows = at[:, None] + np.arange(size)
                made = work(column(table, "clip_id").take(pa.array(at)), t[rows], v[rows], mine)
                if made is not None:
                    yield made

    return over_groups(placed, ["clip_id", "b_"], "t", step, schema)


def sliding_median(x: np.ndarray, half: int) -> np.ndarray:
    """Upper medians down the first axis of x over windows of 2 * half + 1 rows, cut off at the ends; all columns move together.

    The windows' values are kept sorted; a move takes one value out and puts one in, by two counts and one shift of what lies between.
    """
    n, width = len(x), 2 * half + 1
    flat = x.reshape(n, -1)
    padded = np.concatenate([np.full((half, flat.shape[1]), np.inf), flat, np.full((half + 1, flat.shape[1]), np.inf)])
    window = np.sort(padded[:width].T, axis=1)
    place, out = np.arange(width)[None, :], np.empty_like(flat)
    rows = np.arange(flat.shape[1])
    for t in range(n):
        out[t] = window[rows, (min(n - 1, t + half) - max(0, t - half) + 1) // 2]
        old, new = padded[t][:, None], padded[t + width][:, None]
        p = (window < old).sum(axis=1)[:, None]
        q = (window < new).sum(axis=1)[:, None] - (old < new)
        left, right = np.concatenate([window[:, 1:], window[:, -1:]], axis=1), np.concatenate([window[:, :1], window[:, :-1]], axis=1)
        window = np.where((place >= p) & (place < q), left, np.where((place > q) & (place <= p), right, window))
        window[rows, q[:, 0]] = new[:, 0]
    return out.reshape(x.shape)


class Projection:
    """From spectra of frames to the signal they overlap in and back to spectra.

    ``synthesis`` makes frames of ``size`` samples from spectra, which are multiplied by ``w`` and added over the sum of its squares; ``analysis``
    takes frames of ``length`` samples, both centred on multiples of ``hop``. Zeros lie beyond a clip's ends.
    """

    def __init__(self, hop: int, w: np.ndarray, synthesis: Callable[[np.ndarray], np.ndarray], analysis: Callable[[np.ndarray], np.ndarray], length: int):
        self.hop, self.w, self.synthesis, self.analysis, self.size, self.length = hop, np.asarray(w, dtype=float), synthesis, analysis, len(w), length
        #: Frames on either side that a frame's spectrum depends on.
        self.reach = max(1, -(-(self.size + length) // (2 * hop)) - 1)

    def __call__(self, c: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
        """c: clips, frames, bins. begins, ends: whether the first and the last frame are those of the clip."""
        g, frames, _ = c.shape
        hop, parts = self.hop, -(-self.size // self.hop)
        total, weight = np.zeros((g, frames + parts - 1, hop)), np.zeros((frames + parts - 1, hop))
        v = np.zeros((g, frames, parts * hop))
        v[:, :, : self.size] = self.synthesis(c) * self.w
        ww = np.r_[self.w * self.w, np.zeros(parts * hop - self.size)]
        for s in range(parts):
            total[:, s : s + frames] += v[:, :, s * hop : (s + 1) * hop]
            weight[s : s + frames] += ww[s * hop : (s + 1) * hop]
        x = (total / np.maximum(weight, 1e-10)).reshape(g, -1)
        half = self.size // 2
        if begins:
            x[:, :half] = 0
        if ends:
            x[:, half + (frames - 1) * hop :] = 0
        first = half - self.length // 2  # of the first frame in x
        left, right = max(0, -first), max(0, first + (frames - 1) * hop + self.length - x.shape[1])
        x = np.pad(x, ((0, 0), (left, right)))
        return self.analysis(np.lib.stride_tricks.sliding_window_view(x, self.length, axis=1)[:, first + left :: hop][:, :frames])


#: A frame between rounds: its magnitudes, its spectrum, what the last round made of it, and on a block's first frame that block's squared errors.
STATE = "t int, mag array<double>, re array<double>, im array<double>, r0 array<double>, i0 array<double>, e array<double>"


def advance(state: DataFrame, project: Projection, rounds: int, started: bool, momentum: float, stop: bool = False, per: int | None = None) -> DataFrame:
    """The frames (clip_id, STATE) after ``rounds`` more rounds; with ``stop``, a column, after as many as that says of each clip."""
    halo = rounds * project.reach
    per = per or max(64, 20 * halo)
    scale = momentum / (1 + momentum)
    placed = state.drop("e").withColumn("b_", reaching("t", per, halo, halo))
    names = ["re", "im", "r0", "i0"]

    def step(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, b = table.column("t").to_numpy().astype(np.int64), table.column("b_").to_numpy().astype(np.int64)[starts]
        stops = np.r_[starts[1:], len(t)]
        sizes, first, last = stops - starts, t[starts], t[stops - 1]
        ends = last < (b + 1) * per + halo - 1
        arrays = {n: matrix(column(table, n)) for n in ("mag", *names)}
        until = table.column("stop").to_numpy()[starts] if stop else np.full(len(starts), rounds)
        alike: dict[tuple, list[int]] = {}
        most = max(1, HELD // max(1, int(sizes.max()) * arrays["mag"].shape[1]))
        for k in range(len(starts)):
            key = (int(sizes[k]), bool(first[k] == 0), bool(ends[k]), int(first[k] - b[k] * per))
            own = alike.setdefault(key, [])
            own.append(k)
            if len(own) == most:
                yield from work(table, t, arrays, starts, until, alike.pop(key), key)
        for key, own in alike.items():
            yield from work(table, t, arrays, starts, until, own, key)

    def work(table: pa.Table, t: np.ndarray, arrays: dict, starts: np.ndarray, until: np.ndarray, own: list[int], key: tuple) -> Iterator[pa.RecordBatch]:
        size, begins, ends, offset = key
        mine = slice(max(0, -offset), min(size, per - offset))
        if mine.start >= mine.stop:  # a halo of frames behind the clip's last block
            return
        at = starts[own][:, None] + np.arange(size)
        mag = arrays["mag"][at]
        c, before = arrays["re"][at] + 1j * arrays["im"][at], arrays["r0"][at] + 1j * arrays["i0"][at]
        errors, limit = np.zeros((len(own), rounds)), until[own][:, None, None]
        for k in range(rounds):
            made = project(c, begins, ends)
            errors[:, k] = ((np.abs(made) - mag)[:, mine] ** 2).sum(axis=(1, 2))
            turned = made - scale * before if momentum and (started or k) else made
            size_ = np.abs(turned)
            new = mag * np.where(size_ > 0, turned / np.where(size_ > 0, size_, 1), 1)
            going = k < limit
            c, before = np.where(going, new, c), np.where(going, made, before)
        pick = at[:, mine]
        n = pick.shape[1]
        e = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(np.arange(len(own) * n) % n == 0, rounds, 0))].astype(np.int32)), pa.array(errors.ravel()))
        flat = lambda x: rows_of(x[:, mine].reshape(len(own) * n, -1))
        yield pa.RecordBatch.from_arrays(
            [column(table, "clip_id").take(pa.array(pick.ravel())), pa.array(t[pick.ravel()].astype(np.int32)), *(flat(x) for x in (mag, c.real, c.imag, before.real, before.imag)), e],
            names=["clip_id", "t", "mag", *names, "e"],
        )

    return over_groups(placed, ["clip_id", "b_"], "t", step, f"{typed(state, ['clip_id'])}, {STATE}")


def rebuilt(start: DataFrame, project: Projection, rounds: int, momentum: float, at_once: int = 8, per: int | None = None, best_of: bool = True) -> DataFrame:
    """(clip_id, t, re, im): spectra of the magnitudes of ``start`` (clip_id, t, mag, re, im), consistent with a signal as far as ``rounds`` rounds bring them.

    With ``best_of`` the phases of the round of the smallest error over the whole clip are taken, else the last ones. Errors of blocks are summed by clip; as no
    block knows then whether its round was the best one, the rounds up to it are made once more from the last stop before it.
    """
    state = cut(start.select("clip_id", F.col("t").cast("int").alias("t"), "mag", "re", "im", F.col("re").alias("r0"), F.col("im").alias("i0"), F.lit(None).cast("array<double>").alias("e")))
    stops, errors, done = [], None, 0
    while done < rounds:
        k = min(at_once, rounds - done)
        stops.append((done, k, state))
        state = cut(advance(state, project, k, done > 0, momentum, per=per))
        if not best_of:
            done += k
            continue
        own = state.where("size(e) > 0").select("clip_id", F.posexplode("e").alias("i", "x")).groupBy("clip_id", (F.col("i") + done).alias("round")).agg(F.sum("x").alias("x"))
        errors = own if errors is None else errors.unionByName(own)
        done += k
    if not best_of:
        return state.select("clip_id", "t", "re", "im")
    best = cut(errors.groupBy("clip_id").agg(F.min_by("round", F.struct("x", "round")).alias("best_")))
    used = {r["best_"] for r in best.select("best_").distinct().collect()}  # a row a round
    found = state.select("clip_id", "t", "re", "im").limit(0)
    for done, k, at in (x for x in stops if used & set(range(x[0], x[0] + x[1]))):
        chosen = best.where(F.col("best_").between(done, done + k - 1)).select("clip_id", (F.col("best_") - done + 1).cast("int").alias("stop"))
        one = advance(at.join(chosen, "clip_id"), project, k, done > 0, momentum, True, per).select("clip_id", "t", "re", "im")
        found = found.unionByName(one)
    return found


def hashed_phase(seed: int) -> str:
    """SQL of an angle from a hash of clip, frame and bin, for a lambda (x, i)."""
    return f"2 * pi() * pmod(xxhash64(clip_id, t, i, {seed}), 1000003) / 1000003"


def polar_start(magnitudes: DataFrame, angle: str) -> DataFrame:
    """(clip_id, t, mag, re, im) of magnitudes (clip_id, t, v) with the angles of an SQL expression of clip_id, t and the bin i."""
    made = magnitudes.select("clip_id", "t", F.col("v").alias("mag"), F.expr(f"transform(v, (x, i) -> cast({angle} as double))").alias("a_"))
    return made.select("clip_id", "t", "mag", F.expr("zip_with(mag, a_, (m, a) -> m * cos(a))").alias("re"), F.expr("zip_with(mag, a_, (m, a) -> m * sin(a))").alias("im"))


def hann(length: int) -> np.ndarray:
    return np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / length) for i in range(length)])
