"""Alignment of two sequences of frames (dynamic time warping) by tiles on a wavefront.

The table of accumulated costs is cut into tiles. A tile needs the last row of the tile above and the last column of the one to its left, so all
tiles of an anti-diagonal, of all pairs, are worked on at a time, and only borders go on to the next one. The way back
goes over the anti-diagonals once more: each pair's tile of the moment is filled again from its stored borders and followed to where the path
leaves it. Memory is a tile a task, whatever the lengths, and what is stored grows with the product of the lengths over the side of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import lists_of
from wavemill.operators.lineage import cut

#: Frames on a side of a tile.
TILE = 1024
#: Costs that are filled at once where many tiles are of one size.
CELLS = 1 << 22


def costs(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances (..., n, m) of frames (..., n, features) and (..., m, features)."""
    if metric == "cosine":
        n = np.sqrt((a * a).sum(axis=-1))[..., :, None] * np.sqrt((b * b).sum(axis=-1))[..., None, :]
        return np.where(n > 0, 1 - (a @ np.swapaxes(b, -1, -2)) / np.where(n > 0, n, 1), 1.0)
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"no metric {metric!r}")
    out = np.zeros((*a.shape[:-1], b.shape[-2]))
    for f in range(a.shape[-1]):
        d = a[..., :, None, f] - b[..., None, :, f]
        out += d * d if metric == "euclidean" else np.abs(d)
    return np.sqrt(out) if metric == "euclidean" else out


def inside(i: np.ndarray, j: np.ndarray, n: int, m: int, window: str | None, param: int | None) -> np.ndarray:
    """Which places (i, j) of n by m a path may go through: all; within ``param`` of the diagonal (band); or so that the slopes from the start and
    to the end, over that of the diagonal, lie between 1 / ``param`` and ``param`` (itakura, 2 by default)."""
    i, j = np.asarray(i)[:, None], np.asarray(j)[None, :]
    if window is None:
        return np.ones((i.shape[0], j.shape[1]), dtype=bool)
    if window == "band":
        return np.abs(j - (i * m) // n) <= (max(n, m) if param is None else param)
    if window != "itakura":
        raise ValueError(f"no window {window!r}")
    slope = float(2 if param is None else param)
    with np.errstate(divide="ignore", invalid="ignore"):
        since = (j / i) / (m / n)
        left = ((m - 1 - j) / (n - 1 - i)) / (m / n)
    ok = ((i == 0) | ((since >= 1 / slope) & (since <= slope))) & ((i == n - 1) | ((left >= 1 / slope) & (left <= slope)))
    return ok | ((i == 0) & (j == 0)) | ((i == n - 1) & (j == m - 1))


def fill(cost: np.ndarray, top: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Accumulated costs (g, r + 1, c + 1) of g tiles (g, r, c) with their borders: the row above from the corner on (g, c + 1), the column before (g, r)."""
    g, r, c = cost.shape
    out = np.full((g, r + 1, c + 1), np.inf)
    out[:, 0], out[:, 1:, 0] = top, left
    if c == 1:
        for i in range(r):
            out[:, i + 1, 1] = cost[:, i, 0] + np.minimum(np.minimum(out[:, i, 0], out[:, i, 1]), out[:, i + 1, 0])
        return out
    flat, own = out.reshape(g, -1), cost.reshape(g, -1)
    for s in range(r + c - 1):  # cells (i, s - i) lie c places from each other in the table and c - 1 in the costs
        low, high = max(0, s - c + 1), min(r - 1, s)
        count = high - low + 1
        at = lambda first: slice(low * c + first, low * c + first + (count - 1) * c + 1, c)  # noqa: B023, E731
        best = np.minimum(np.minimum(flat[:, at(s)], flat[:, at(s + 1)]), flat[:, at(s + c + 1)])
        first = low * (c - 1) + s
        flat[:, at(s + c + 2)] = own[:, first : first + (count - 1) * (c - 1) + 1 : c - 1] + best
    return out


def follow(table: np.ndarray, i: int, j: int, stop_at_top: bool) -> tuple[list[tuple[int, int]], int, int]:
    """Cells of a filled tile from (i, j) back, ties diagonal, up, left, and the place beyond its border where the path goes on; -1, -1 at a start."""
    path = []
    while i >= 0 and j >= 0:
        path.append((i, j))
        steps = (table[i, j], table[i, j + 1], table[i + 1, j])
        k = int(np.argmin(steps))
        if stop_at_top and i == 0 or not np.isfinite(steps[k]):
            return path, -1, -1
        i, j = i - (k < 2), j - (k != 1)
    return path, i, j


def short_paths(x: np.ndarray, y: np.ndarray, metric: str, subsequence: bool, window: str | None, param: int | None) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """Cost and path of each of g pairs of sequences (g, n, features) and (g, m, features), one tile a pair; no path where the window allows none."""
    g, n, m = len(x), x.shape[1], y.shape[1]
    cost = np.where(inside(np.arange(n), np.arange(m), n, m, window, param), costs(x, y, metric), np.inf)
    top = np.full((g, m + 1), 0.0 if subsequence else np.inf)
    top[:, 0] = 0
    filled = fill(cost, top, np.full((g, n), np.inf))
    for table in filled:
        j = int(table[n, 1:].argmin()) if subsequence else m - 1
        best = float(table[n, j + 1])
        yield best, follow(table, n - 1, j, subsequence)[0][::-1] if np.isfinite(best) else []


def align(pairs: DataFrame, metric: str = "euclidean", subsequence: bool = False, window: str | None = None, param: int | None = None) -> DataFrame:
    """(pair_id, cost, normalised, path) for rows (pair_id, x, y), x and y arrays of frames (arrays of numbers), each one tile.

    For sequences of some thousand frames; ``align_tall`` takes longer ones. Pairs of one size are filled together. Empty sequences and windows
    without a path give null costs and an empty path. ``subsequence``: x may lie anywhere in y.
    """
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple[int, int], list[tuple]] = {}
            out = []
            for key, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not x or not y:
                    out.append((key, None, None, []))
                else:
                    alike.setdefault((len(x), len(y)), []).append((key, x, y))
            for (n, m), own in alike.items():
                most = max(1, CELLS // (n * m))
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    x, y = (np.array([p[z] for p in part], dtype=float) for z in (1, 2))
                    for (key, _, _), (best, path) in zip(part, short_paths(x, y, metric, subsequence, window, param), strict=True):
                        out.append((key, best if path else None, best / len(path) if path else None, [{"i": i, "j": j} for i, j in path]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["pair_id", "cost", "normalised", "path"])

    return pairs.select(F.col("pair_id").cast("long"), "x", "y").mapInArrow(run, "pair_id long, cost double, normalised double, path array<struct<i:int,j:int>>")


def _blocks(frames: DataFrame, t: str, side: str, tile: int) -> DataFrame:
    """(pair_id, block, n, values): frames in blocks of ``tile``, flat, with the sequence's length."""
    sizes = frames.groupBy("pair_id").agg(F.max(t).alias(f"n_{side}"))
    made = frames.groupBy("pair_id", F.floor(F.col(t) / tile).cast("int").alias(f"b_{side}")).agg(F.expr(f"flatten(transform(array_sort(collect_list(struct({t} as t, cast(v as array<double>) as v))), s -> s.v))").alias(side), F.count(F.lit(1)).alias(f"c_{side}"))
    return made.join(sizes, "pair_id").select("pair_id", f"b_{side}", (F.col(f"n_{side}") + 1).cast("int").alias(f"n_{side}"), F.col(f"c_{side}").cast("int").alias(f"c_{side}"), side)


#: A tile's place, its borders as they came, and as they go on.
BORDERS = "pair_id long, b_x int, b_y int, top array<double>, left array<double>, bottom array<double>, right array<double>, final double, final_j int"


def _tile_costs(row: dict, tile: int, metric: str, window: str | None, param: int | None) -> np.ndarray:
    x, y = (np.asarray(row[s], dtype=float).reshape(row[f"c_{s}"], -1) for s in "xy")
    at_x, at_y = row["b_x"] * tile + np.arange(len(x)), row["b_y"] * tile + np.arange(len(y))
    ok = inside(at_x, at_y, row["n_x"], row["n_y"], window, param)
    return np.where(ok, costs(x, y, metric), np.inf) if ok.any() else np.full(ok.shape, np.inf)


def _rows(batch: pa.RecordBatch, scalars: list[str], arrays: list[str]) -> Iterator[dict]:
    plain = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in scalars}
    for k in range(batch.num_rows):
        row = {n: v[k] for n, v in plain.items()}
        for n in arrays:
            cell = batch.column(batch.schema.get_field_index(n))[k]
            row[n] = np.asarray(cell.values) if cell.is_valid else None
        yield row


def _swept(tiles: DataFrame, tile: int, metric: str, subsequence: bool, window: str | None, param: int | None) -> DataFrame:
    """BORDERS of tiles (pair_id, b_x, b_y, top, left, and the blocks' columns)."""
    names = [x.split()[0] for x in BORDERS.split(", ")]

    def one(row: dict) -> tuple:
        cost = _tile_costs(row, tile, metric, window, param)
        r, c = cost.shape
        top, left = row["top"], row["left"]
        if row["b_x"] == 0:
            top = np.full(c + 1, 0.0 if subsequence else np.inf)
            if row["b_y"] == 0:
                top[0] = 0
        elif top is None:  # the tile above was not needed by any path
            top = np.full(c + 1, np.inf)
        left = np.full(r, np.inf) if left is None else left
        table = fill(cost[None], top[None], left[None])[0]
        last = row["b_x"] * tile + r == row["n_x"]
        final, at = np.inf, -1
        if last and subsequence:
            at = int(table[r, 1:].argmin())
            final, at = float(table[r, at + 1]), at + row["b_y"] * tile
        elif last and row["b_y"] * tile + c == row["n_y"]:
            final, at = float(table[r, c]), row["n_y"] - 1
        return row["pair_id"], row["b_x"], row["b_y"], top, left, np.r_[left[-1], table[r, 1:]], table[1:, c], final, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(row) for row in _rows(batch, ["pair_id", "b_x", "b_y", "n_x", "n_y", "c_x", "c_y"], ["top", "left", "x", "y"])]
            if made:
                flat = lambda k: lists_of(np.concatenate([m[k] for m in made]), np.array([len(m[k]) for m in made]))  # noqa: B023, E731
                kinds = [pa.int64(), pa.int32(), pa.int32(), None, None, None, None, pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([flat(k) if kind is None else pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)

    return tiles.mapInArrow(run, BORDERS)


#: Where a pair's path goes on.
HEAD = "pair_id long, b_x int, b_y int, i int, j int"


def _followed(tiles: DataFrame, tile: int, metric: str, subsequence: bool, window: str | None, param: int | None) -> DataFrame:
    """HEAD of the next tile (b_x below 0: none) and path, of tiles with the head in them and their borders."""
    def one(row: dict) -> tuple:
        table = fill(_tile_costs(row, tile, metric, window, param)[None], row["top"][None], row["left"][None])[0]
        x0, y0 = row["b_x"] * tile, row["b_y"] * tile
        path, i, j = follow(table, row["i"] - x0, row["j"] - y0, subsequence and x0 == 0)
        ended = (i, j) == (-1, -1) and (x0 == 0 or y0 == 0)
        i, j = i + x0, j + y0
        ended = ended or i < 0 or j < 0
        return row["pair_id"], -1 if ended else i // tile, -1 if ended else j // tile, i, j, [{"i": a + x0, "j": b + y0} for a, b in path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(row) for row in _rows(batch, ["pair_id", "b_x", "b_y", "n_x", "n_y", "c_x", "c_y", "i", "j"], ["top", "left", "x", "y"])]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["pair_id", "b_x", "b_y", "i", "j", "path"])

    return tiles.mapInArrow(run, f"{HEAD}, path array<struct<i:int,j:int>>")


def _in_band(tile: int, window: str | None, param: int | None):
    """Whether a tile has a place inside a band or next to it, which a path may pass at a corner; other windows are seen to in the tile."""
    if window != "band" or param is None:
        return F.lit(True)
    end = (F.col("b_x") * tile + tile >= F.col("n_x")) & (F.col("b_y") * tile + tile >= F.col("n_y"))
    low, high = F.col("b_x") * tile, F.least(F.col("b_x") * tile + tile, F.col("n_x")) - 1
    first, last = F.floor(low * F.col("n_y") / F.col("n_x")) - param - 1, F.floor(high * F.col("n_y") / F.col("n_x")) + param + 1
    return end | ((F.col("b_y") * tile <= last) & (F.col("b_y") * tile + tile - 1 >= first))


def align_tall(x: DataFrame, y: DataFrame, metric: str = "euclidean", subsequence: bool = False, window: str | None = None, param: int | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(pair_id, cost, normalised, steps) and the paths (pair_id, i, j), for sequences of any length as rows (pair_id, t, v) of x and of y.

    Frames are numbered from 0 without gaps. Each anti-diagonal of tiles is one round over all pairs, there and back. Pairs
    without frames on a side have no row; where the window allows no path the cost is null and there are no steps.
    """
    xs, ys = cut(_blocks(x, "t", "x", tile)), cut(_blocks(y, "t", "y", tile))
    rounds = xs.groupBy("pair_id").agg(F.max("b_x").alias("b_x")).join(ys.groupBy("pair_id").agg(F.max("b_y").alias("b_y")), "pair_id").agg(F.max(F.col("b_x") + F.col("b_y"))).first()[0]
    none = F.lit(None).cast("array<double>")
    todo = xs.where("b_x = 0").select("pair_id", "b_x").join(ys.where("b_y = 0").select("pair_id", "b_y"), "pair_id").select("pair_id", "b_x", "b_y", none.alias("top"), none.alias("left"))
    stored: list[DataFrame] = []
    for _ in range(0 if rounds is None else rounds + 1):
        tiles = todo.join(xs, ["pair_id", "b_x"]).join(ys, ["pair_id", "b_y"]).where(_in_band(tile, window, param))
        stored.append(cut(_swept(tiles, tile, metric, subsequence, window, param)))
        below = stored[-1].select("pair_id", (F.col("b_x") + 1).alias("b_x"), "b_y", F.col("bottom").alias("top"), none.alias("left"))
        beside = stored[-1].select("pair_id", "b_x", (F.col("b_y") + 1).alias("b_y"), none.alias("top"), F.col("right").alias("left"))
        todo = below.unionByName(beside).groupBy("pair_id", "b_x", "b_y").agg(F.first("top", ignorenulls=True).alias("top"), F.first("left", ignorenulls=True).alias("left"))
    spark = x.sparkSession
    if not stored:
        return spark.createDataFrame([], "pair_id long, cost double, normalised double, steps long"), spark.createDataFrame([], "pair_id long, i int, j int")
    ends = [s.where("final_j >= 0").select("pair_id", "b_x", "b_y", "final", "final_j") for s in stored]
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    every = xs.where("b_x = 0").select("pair_id", "n_x").join(ys.where("b_y = 0").select("pair_id"), "pair_id")
    best = cut(every.join(last.groupBy("pair_id").agg(F.min(F.struct("final", "final_j", "b_x", "b_y")).alias("e")), "pair_id", "left"))
    heads = best.where("e.final < double('Infinity')").select("pair_id", "e.b_x", "e.b_y", (F.col("n_x") - 1).alias("i"), F.col("e.final_j").alias("j"))
    paths: list[DataFrame] = []
    for d in range(len(stored) - 1, -1, -1):
        here = heads.where(F.col("b_x") + F.col("b_y") == d)
        tiles = here.join(stored[d].select("pair_id", "b_x", "b_y", "top", "left"), ["pair_id", "b_x", "b_y"]).join(xs, ["pair_id", "b_x"]).join(ys, ["pair_id", "b_y"])
        gone = cut(_followed(tiles, tile, metric, subsequence, window, param))
        paths.append(gone.select("pair_id", F.explode("path").alias("p")).select("pair_id", "p.i", "p.j"))
        heads = cut(heads.where(F.col("b_x") + F.col("b_y") < d).unionByName(gone.where("b_x >= 0").select(*(c.split()[0] for c in HEAD.split(", ")))))
    path = paths[0]
    for p in paths[1:]:
        path = path.unionByName(p)
    steps = path.groupBy("pair_id").agg(F.count(F.lit(1)).alias("steps"))
    cost = F.when(F.col("e.final") < float("inf"), F.col("e.final"))
    return best.join(steps, "pair_id", "left").select("pair_id", cost.alias("cost"), (cost / F.col("steps")).alias("normalised"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps")), path
