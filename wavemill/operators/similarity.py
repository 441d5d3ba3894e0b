"""Joins of frames with frames and with segments: distances, neighbours, recurrence, alignment, synchronisation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.arrays import dot, let, squares, total
from wavemill.operators.blocks import over_frames, rows_of, typed


def distance(a: str, b: str, metric: str = "euclidean") -> Column:
    if metric == "euclidean":
        return F.expr(f"sqrt({squares(f'zip_with({a}, {b}, (x, y) -> x - y)')})")
    if metric == "manhattan":
        return F.expr(total(f"zip_with({a}, {b}, (x, y) -> abs(x - y))"))
    if metric == "cosine":
        return F.expr(let(f"sqrt({squares(a)} * {squares(b)})", "n", f"case when n > 0 then 1 - {dot(a, b)} / n else 1D end"))
    raise ValueError(f"no metric {metric!r}")


def _sides(frames: DataFrame, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return frames.select("clip_id", F.col("t").alias("i"), F.col("v").alias("a_")), (other or frames).select("clip_id", F.col("t").alias("j"), F.col("v").alias("b_"))


def pairwise(frames: DataFrame, other: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(clip_id, i, j, dist) of all frames of two signals of the same clip_id: the cost matrix of an alignment."""
    a, b = _sides(frames, other)
    return a.join(b, "clip_id").select("clip_id", "i", "j", distance("a_", "b_", metric).alias("dist"))


def _rows_distances(v: np.ndarray, width: int, metric: str) -> np.ndarray:
    """(blocks, frames, 2 * width + 1): distances of frames (blocks, frames, features) to those at offsets -width to width; infinite beyond the ends and to itself.

    One pass over the frames for each offset, which serves both directions; no pair outside the band is looked at.
    """
    g, n, _ = v.shape
    out = np.full((g, n, 2 * width + 1), np.inf)
    squares_ = (v * v).sum(axis=2)
    for d in range(1, min(width, n - 1) + 1):
        a, b = v[:, :-d], v[:, d:]
        if metric == "euclidean":
            x = np.sqrt(((a - b) ** 2).sum(axis=2))
        elif metric == "manhattan":
            x = np.abs(a - b).sum(axis=2)
        elif metric == "cosine":
            size = np.sqrt(squares_[:, :-d] * squares_[:, d:])
            x = np.where(size > 0, 1 - (a * b).sum(axis=2) / np.where(size > 0, size, 1), 1.0)
        else:
            raise ValueError(f"no metric {metric!r}")
        out[:, :-d, width + d], out[:, d:, width - d] = x, x
    return out


def _selected(dist: np.ndarray, k: int) -> np.ndarray:
    """Places (rows, k) of the k smallest of each row in their order, ties to the first; those of infinite distance last."""
    k = min(k, dist.shape[1])
    last = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
    less, ties = dist < last, dist == last
    chosen = less | (ties & (np.cumsum(ties, axis=1) <= k - less.sum(axis=1, keepdims=True)))
    at = np.nonzero(chosen)[1].reshape(len(dist), k)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(dist, at, axis=1), axis=1, kind="stable"), axis=1)


def band_pairs(frames: DataFrame, width: int, metric: str = "euclidean") -> DataFrame:
    """(clip_id, i, j, dist) of different frames at most ``width`` apart, by blocks of frames with as many around them."""
    return _band(frames, width, None, metric).drop("rank")


def nearest_in_band(frames: DataFrame, width: int, k: int, metric: str = "euclidean") -> DataFrame:
    """(clip_id, i, j, dist, rank): each frame's k nearest at most ``width`` apart, ties by place, rank from 1; selected where the distances are made."""
    return _band(frames, width, k, metric)


def _band(frames: DataFrame, width: int, k: int | None, metric: str) -> DataFrame:
    def work(clip: pa.Array, t: np.ndarray, v: np.ndarray, mine: slice) -> pa.RecordBatch:
        dist = _rows_distances(v, width, metric)[:, mine].reshape(-1, 2 * width + 1)
        i = t[:, mine].ravel()
        at = np.tile(np.arange(2 * width + 1), (len(i), 1)) if k is None else _selected(dist, k)
        found = np.isfinite(np.take_along_axis(dist, at, axis=1))
        row, rank = np.nonzero(found)
        j = i[row] + at[row, rank] - width
        per = mine.stop - mine.start
        columns = [clip.take(pa.array(row // per)), pa.array(i[row].astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(dist[row, at[row, rank]]), pa.array((rank + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["clip_id", "i", "j", "dist", "rank"])

    return over_frames(frames.withColumn("v", F.col("v").cast("array<double>")), max(64, 16 * width), width, width, work, f"{typed(frames, ['clip_id'])}, i int, j int, dist double, rank int")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest distances of every frame, ties by the other frame's place: adds rank from 1."""
    w = Window.partitionBy("clip_id", "i").orderBy("dist", "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _folded(frames: DataFrame, width: int, k: int, metric: str, fold: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """(clip_id, t, names): arrays over the features that ``fold`` makes of a frame and its k nearest neighbours in the band, where they lie."""
    def work(clip: pa.Array, t: np.ndarray, v: np.ndarray, mine: slice) -> pa.RecordBatch | None:
        g, size, features = v.shape
        n = mine.stop - mine.start
        dist = _rows_distances(v, width, metric)[:, mine].reshape(g * n, 2 * width + 1)
        at = _selected(dist, k)
        at = np.where(np.isfinite(np.take_along_axis(dist, at, axis=1)), at, -1)
        count = (at >= 0).sum(axis=1)
        block, place = np.repeat(np.arange(g), n), np.tile(np.arange(mine.start, mine.stop), g)
        made = [np.zeros((g * n, features)) for _ in names]
        for c in np.unique(count[count > 0]).tolist():  # frames with fewer neighbours than k stand near the ends of short clips
            own = np.flatnonzero(count == c)
            near = v[block[own][:, None], place[own][:, None] + at[own, :c] - width]
            for to, x in zip(made, fold(v[block[own], place[own]], near), strict=True):
                to[own] = x
        some = np.flatnonzero(count)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([clip.take(pa.array(block[some])), pa.array(t[:, mine].ravel()[some].astype(np.int32)), *(rows_of(m[some]) for m in made)], names=["clip_id", "t", *names])

    schema = f"{typed(frames, ['clip_id'])}, t int, " + ", ".join(f"{n} array<double>" for n in names)
    return over_frames(frames.withColumn("v", F.col("v").cast("array<double>")), max(64, 16 * width), width, width, work, schema)


def neighbour_filter(frames: DataFrame, width: int, k: int, how: str = "mean", metric: str = "cosine") -> DataFrame:
    """(clip_id, t, v): each feature's mean, median, min or max over a frame's k nearest neighbours in the band."""
    step = {"mean": np.mean, "median": np.median, "min": np.min, "max": np.max}[how]
    return _folded(frames, width, k, metric, lambda own, near: [step(near, axis=1)], ["v"])


def soft_mask(frames: DataFrame, width: int, k: int, metric: str = "cosine") -> DataFrame:
    """(clip_id, t, f, x, filtered, mask): 1 / (1 + distance from the neighbours' median in median deviations)."""
    def fold(own: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        median = np.median(near, axis=1)
        deviation = np.median(np.abs(near - median[:, None]), axis=1)
        return [own, median, 1 / (1 + np.abs(own - median) / (deviation + 1e-10))]

    rows = _folded(frames, width, k, metric, fold, ["x", "filtered", "mask"]).select("clip_id", "t", F.posexplode(F.arrays_zip("x", "filtered", "mask")).alias("f", "z"))
    return rows.select("clip_id", "t", "f", "z.x", "z.filtered", "z.mask")


def decompose(masked: DataFrame) -> DataFrame:
    """Repeating and other part of each value, from ``soft_mask``."""
    return masked.select("clip_id", "t", "f", F.col("filtered").alias("repeating"), (F.greatest(F.lit(0.0), F.col("x") - F.col("filtered")) * (2 - F.col("mask"))).alias("other"))


def recurrence(frames: DataFrame, metric: str = "euclidean", k: int | None = None, width: int | None = None, threshold: float | None = None) -> DataFrame:
    """(clip_id, i, j, dist): the links of a recurrence matrix; an absent row is no link.

    ``width`` limits pairs to a band, ``k`` keeps each frame's nearest made symmetric, ``threshold`` the near ones.
    Without ``width`` all frames of a clip meet each other, which is the operator's definition: use it on short clips.
    """
    if width is None:
        a, b = _sides(frames)
        pairs = a.join(b, "clip_id").where("i <> j").select("clip_id", "i", "j", distance("a_", "b_", metric).alias("dist"))
    else:
        pairs = band_pairs(frames, width, metric) if k is None else nearest_in_band(frames, width, k, metric)
    if k is not None:
        near = (pairs if width is not None else nearest(pairs, k)).select("clip_id", "i", "j", "dist")
        pairs = near.unionByName(near.select("clip_id", F.col("j").alias("i"), F.col("i").alias("j"), "dist")).distinct()
    return pairs if threshold is None else pairs.where(F.col("dist") <= threshold)


def closest(links: DataFrame, n: int) -> DataFrame:
    """The n links of smallest distance overall, ties by clip and place."""
    return links.orderBy("dist", "clip_id", "i", "j").limit(n)


def recurrence_statistics(links: DataFrame, sizes: DataFrame, least: int = 2) -> DataFrame:
    """(clip_id, rr, det, l, lam, tt): rate, and shares and mean lengths of diagonal and vertical lines of ``least`` and more.

    ``sizes``: (clip_id, n_frames). Lines are runs along a diagonal or a column: gaps and islands.
    """
    def lines(key: Column, at: str) -> DataFrame:
        w = Window.partitionBy("clip_id", "key").orderBy(at)
        runs = links.withColumn("key", key).withColumn("g", F.col(at) - F.row_number().over(w))
        return runs.groupBy("clip_id", "key", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("clip_id").agg(
            F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)).alias("in_lines"), F.sum(F.when(F.col("n") >= least, 1).otherwise(0)).alias("n_lines"), F.sum("n").alias("all"))

    d = lines(F.col("j") - F.col("i"), "i").select("clip_id", (F.col("in_lines") / F.col("all")).alias("det"), F.when(F.col("n_lines") > 0, F.col("in_lines") / F.col("n_lines")).otherwise(0.0).alias("l"), F.col("all").alias("links_"))
    v = lines(F.col("j"), "i").select("clip_id", (F.col("in_lines") / F.col("all")).alias("lam"), F.when(F.col("n_lines") > 0, F.col("in_lines") / F.col("n_lines")).otherwise(0.0).alias("tt"))
    joined = sizes.join(d, "clip_id", "left").join(v, "clip_id", "left")
    return joined.select("clip_id", (F.coalesce("links_", F.lit(0)) / (F.col("n_frames") * F.col("n_frames"))).alias("rr"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("det", "l", "lam", "tt")))


def synchronise(frames: DataFrame, bounds: DataFrame, how: str = "mean", per: int = 1 << 14) -> DataFrame:
    """(clip_id, seg, v): features folded over the segments between boundaries (clip_id, b), 0 and the end added.

    An empty segment has zeros. The interval join is a window: a frame's segment is the number of boundaries up to it.
    """
    from wavemill.operators.features import wide

    ends = frames.groupBy("clip_id").agg((F.max("t") + 1).alias("n"), F.first(F.size("v")).alias("w"))
    cuts = bounds.join(ends, "clip_id").where("b > 0 and b < n").select("clip_id", "b").unionByName(ends.select("clip_id", F.lit(0).alias("b"))).distinct()
    segs = cuts.withColumn("seg", F.row_number().over(Window.partitionBy("clip_id").orderBy("b")) - 1)
    # A frame's segment is the last one that begins at it or before: in its stretch of the clip, else the last of an earlier stretch.
    keyed = frames.select("clip_id", F.col("t").cast("long").alias("t"), F.col("v").cast("array<double>").alias("v")).withColumn("b_", F.floor(F.col("t") / per))
    marks = segs.select("clip_id", F.col("b").cast("long").alias("t"), "seg", F.floor(F.col("b") / per).alias("b_"))
    some = marks.groupBy("clip_id", "b_").agg(F.max("seg").alias("m_")).unionByName(keyed.select("clip_id", "b_").distinct().withColumn("m_", F.lit(None).cast("int")))
    earlier = Window.partitionBy("clip_id").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    known = some.groupBy("clip_id", "b_").agg(F.max("m_").alias("m_")).select("clip_id", "b_", F.max("m_").over(earlier).alias("e_"))
    both = keyed.select("clip_id", "b_", "t", F.lit(None).cast("int").alias("seg"), "v", F.lit(1).alias("k")).unionByName(marks.select("clip_id", "b_", "t", "seg", F.lit(None).cast("array<double>").alias("v"), F.lit(0).alias("k")))
    w = Window.partitionBy("clip_id", "b_").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("seg", F.max("seg").over(w)).where("k = 1").join(known, ["clip_id", "b_"]).withColumn("seg", F.coalesce("seg", "e_"))
    values = placed.select("clip_id", "seg", "t", F.posexplode("v").alias("f", "x"))
    fold = {"mean": F.avg("x"), "median": F.median("x"), "max": F.max("x"), "min": F.min("x"), "sum": F.sum("x"), "first": F.min_by("x", "t"), "last": F.max_by("x", "t")}[how]
    folded = values.groupBy("clip_id", "seg", "f").agg(fold.alias("x"))
    return wide(folded.withColumnRenamed("seg", "t")).withColumnRenamed("t", "seg")
