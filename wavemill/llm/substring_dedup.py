"""Substring dedup: MinHash banding of paragraphs.

A text's paragraphs are its lines of LEAST words and more, whole. Equal ones are one class, found by a count. Classes
that meet in a band of MinHash values are compared by the exact Jaccard similarity of their five-word shingles, and
clusters are the components of the links.

Passages are also pasted inside paragraphs and across them. Therefore runs of 20 words count as well, that start where
the content says so: at the smallest shingle hash of every 30 starts in a row. A passage of 49 words or more holds at least one
such run with all that decides about it inside, hence the same run, wherever it is pasted. Equal runs are one class; each
is extended to both sides as far as the words equal those around the class's first run. What lies between two runs is compared
by one hash; fewer than 49 words can follow the last run of a passage, and those are compared one by one.

Of each cluster and class the first place (by doc_id, then start) stays and the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_MIN, cut, drop_cut, fresh, frugal, small_batches, spread, table
from .graph import components

WIDTH, SIMILARITY = 5, 0.8
#: Words that a paragraph has at least. Shorter lines repeat everywhere by nature.
LEAST = 20
#: Words of a run, starts in a row of which one is chosen, and words that can follow the last run of a passage at most.
WORDS, STARTS, AROUND = 20, 30, 48
#: Bands and MinHash values in each: at similarity 0.8 two paragraphs meet with probability 1 - (1 - 0.8**2)**6 = 0.9978.
BANDS, ROWS = 6, 2
#: Classes of a bucket compared in one go.
CHUNK = 1024

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALTS = np.array([(0xD1B54A32D192ED03 * (2 * k + 1)) & (2**64 - 1) for k in range(WORDS + BANDS * ROWS + BANDS)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base of the word hash and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P_INVERSE)])
        return self.up[:n], self.down[:n]


def words_of(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points) of every word, A-Z lower-cased. The hash is polynomial, by prefix sums."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    points = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    return h, points[starts], points[ends]


def shingles_of(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + n] * _SALTS[k]
    return mixed(total)


def chosen_starts(sh: np.ndarray, count: int, starts: int = STARTS) -> np.ndarray:
    """Positions below ``count`` with the smallest hash of some ``starts`` in a row, all of equal ones."""
    v = sh[:count]
    w = min(starts, count)
    low, span = v.copy(), 1
    while span < w:  # minimum over spans of 1, 2, 4, ... and then w
        step = min(span, w - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    # A place is chosen if a window that holds it has its value for a minimum.
    reach = np.r_[np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]
    span = 1
    while span < w:
        step = min(span, w - span)
        reach = np.maximum(reach[: len(reach) - step], reach[step:])
        span += step
    return np.flatnonzero(v == reach[: len(v)])


def one_a_lap(at: np.ndarray, cls: np.ndarray, starts: int = STARTS) -> np.ndarray:
    """Which starts to keep: of whole paragraphs that are equal one after the other, as in a text that goes round, one in a window."""
    new = np.r_[True, cls[1:] != cls[:-1]]
    lap = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // starts
    return new | np.r_[True, np.diff(lap) != 0]


class Text:
    """Words of a text as arrays, its chosen runs and its paragraphs (first word, word after the last)."""

    def __init__(self, text: bytes, powers: Powers):
        self.h, self.first, self.last = words_of(text, powers)
        self.shingles = shingles_of(self.h)
        up, self.down = _STRETCH.to(len(self.h) + 1)
        self.sums = np.zeros(len(self.h) + 1, dtype=np.uint64)
        np.cumsum((self.h ^ _P) * up[: len(self.h)], out=self.sums[1:])
        raw = np.frombuffer(text, dtype=np.uint8)
        breaks = np.flatnonzero(raw == 10)
        starts = np.zeros(0, dtype=np.int64)
        if len(breaks):
            starts = np.searchsorted(self.first, breaks - np.cumsum((raw & 0xC0) == 0x80)[breaks])
        edge = np.unique(np.r_[0, starts, len(self.h)]).astype(np.int64)
        self.lines = np.stack([edge[:-1], edge[1:]], axis=1)[np.diff(edge) >= LEAST]
        self.runs = self.classes = np.zeros(0, dtype=np.int64)
        count = len(self.h) - WORDS + 1
        if count > 0:
            at = chosen_starts(self.shingles, count)
            classes = self.digests(at, at + WORDS)
            kept = one_a_lap(at, classes, min(STARTS, count))
            self.runs, self.classes = at[kept], classes[kept]

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words of each stretch: a polynomial of their hashes by prefix sums."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def keys(self) -> np.ndarray:
        """Band keys of every paragraph."""
        out = np.zeros((len(self.lines), BANDS), dtype=np.uint64)
        if not len(self.lines):
            return out
        # The shingles of line after line, none that crosses an end.
        sizes = self.lines[:, 1] - self.lines[:, 0] - WIDTH + 1
        starts = np.cumsum(sizes) - sizes
        own = self.shingles[np.arange(sizes.sum()) + np.repeat(self.lines[:, 0] - starts, sizes)]
        for b in range(BANDS):
            key = np.full(len(self.lines), b, dtype=np.uint64)
            for r in range(ROWS):
                x = own * _SALTS[WORDS + b * ROWS + r]
                key = mixed(key + _P) ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
            out[:, b] = mixed(key)
        return out


_STRETCH = Powers()


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


#: Of a run: class, place, and the hash and far end of the stretch to the next run and from the one before, 0 without one.
RUN = "doc_id long, row long, cls long, s int, e int, ahead long, ahead_e int, back long, back_s int"
LINE = "doc_id long, row long, cls long, s int, e int, keys array<long>"


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text: null ids as the smallest long, and a hash that tells rows of one id apart."""
    return docs.select(F.coalesce("doc_id", F.lit(LONG_MIN)).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")


def units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and paragraphs (written) of every row, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                out = []
                for d, r, raw in zip(ids, hashes, part.column(2), strict=True):
                    t = Text(raw.as_py(), powers)
                    if n := len(t.runs):
                        a, end = t.runs, t.runs + WORDS
                        link = np.zeros(n + 1, dtype=np.uint64)
                        link[1:-1] = t.digests(a[:-1], end[1:])
                        far, near = np.r_[t.last[end[1:] - 1], 0], np.r_[0, t.first[a[:-1]]]
                        out.append((np.full(n, d), np.full(n, r), t.classes.view(np.int64), t.first[a], t.last[end - 1], link[1:].view(np.int64), far, link[:-1].view(np.int64), near, np.zeros(0, np.uint64), np.zeros(n, np.int64)))
                    if m := len(t.lines):
                        none = np.zeros(m, np.int64)
                        cls = t.digests(t.lines[:, 0], t.lines[:, 1]).view(np.int64)
                        out.append((np.full(m, d), np.full(m, r), cls, t.first[t.lines[:, 0]], t.last[t.lines[:, 1] - 1], none, none, none, none, t.keys().ravel(), np.full(m, BANDS)))
                if out:
                    c = [np.concatenate(x) for x in zip(*out, strict=True)]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(c[:9], kinds, strict=True)), lists(c[9].view(np.int64), c[10], pa.int64())], names=[*(x.split()[0] for x in RUN.split(", ")), "keys"])

    small_batches(rows.sparkSession)
    both = cut(rows.mapInArrow(lambda batches: frugal(run(batches)), RUN + ", keys array<long>"), "units")
    return both.where("size(keys) = 0").drop("keys"), both.where("size(keys) > 0").select(*(x.split()[0] for x in LINE.split(", ")))


#: Of a paragraph its shingles, of a run the AROUND words before (nearest first) and after it, as hashes and places.
DETAIL = "doc_id long, row long, s int, cls long, line boolean, shingles array<long>, before array<int>, before_s array<int>, after array<int>, after_e array<int>"


def details(rows: DataFrame, places: DataFrame) -> DataFrame:
    """What is needed of the paragraphs and runs at ``places`` (doc_id, row, s, e, cls, line): the one shuffle of texts."""
    wanted = places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "e", "cls", "line")).alias("at"))
    texts = rows.dropDuplicates(["doc_id", "row"]).join(wanted.hint("merge"), ["doc_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                yield described(batch.slice(k, 512), powers)

    return texts.select("doc_id", "row", "text", "at").mapInArrow(lambda batches: frugal(run(batches)), DETAIL)


def described(batch: pa.RecordBatch, powers: Powers) -> pa.RecordBatch:
    """The rows of ``details`` of a batch (doc_id, row, text, at)."""
    none, keys, flat = np.zeros(0, np.int64), [], [[] for _ in range(5)]
    for d, r, raw, at in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
        h, first, last = words_of(raw.as_py(), powers)
        low = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        for x in at:
            a, b = int(np.searchsorted(first, x["s"])), int(np.searchsorted(last, x["e"])) + 1
            keys.append((d, r, x["s"], x["cls"], x["line"]))
            if x["line"]:
                own = (np.unique(shingles_of(h[a:b])).view(np.int64), none, none, none, none)
            else:
                back, on = slice(max(0, a - AROUND), a), slice(b, b + AROUND)
                own = (none, low[back][::-1], first[back][::-1], low[on], last[on])
            for to, values in zip(flat, own, strict=True):
                to.append(values)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    columns = [pa.array([x[k] for x in keys], kind) for k, kind in enumerate(kinds)]
    for values, kind in zip(flat, [pa.int64(), *[pa.int32()] * 4], strict=True):
        columns.append(lists(np.concatenate([*values, none]), np.array([len(x) for x in values], dtype=np.int64), kind))
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DETAIL.split(", ")])


def similar_pairs(sets: list[frozenset], second_from: int | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (spanning, not all) among sets of at least this Jaccard similarity; with ``second_from`` only across that place.

    Prefix filter: sorted by rarity, two similar sets share one of their first elements, so only such meet.
    """
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def meet(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    out: list[tuple[int, int]] = []
    if len(sets) <= 16:
        for a, b in combinations(range(len(sets)), 2):
            if second_from is None or a < second_from <= b:
                meet(a, b)
        return out
    seen: dict[int, int] = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    index: dict[int, list[int]] = {}
    for b, s in enumerate(sets):
        order = sorted(s, key=lambda x: (seen[x], x))
        prefix = order[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]
        for x in prefix:
            for a in index.get(x, ()):
                if second_from is None or a < second_from <= b:
                    meet(a, b)
        for x in prefix:
            index.setdefault(x, []).append(b)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, pair, side, cls, shingles arrive sorted. Gives the links of each bucket or pair of chunks."""
    at, own = None, []

    def links() -> list[tuple[int, int]]:
        # First chunk, then second; a bucket that is one chunk has side -1 only.
        own.sort(key=lambda x: x[0])
        cross = sum(1 for x in own if x[0] <= 0) if any(x[0] > 0 for x in own) else None
        if cross is None and own[0][0] == 0:
            return []
        return [(own[a][1], own[b][1]) for a, b in similar_pairs([x[2] for x in own], cross)]

    found: list[tuple[int, int]] = []
    for batch in batches:
        for key, pair, side, cls, shingles in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (key, pair) != at:
                if len(own) > 1:
                    found += links()
                at, own = (key, pair), []
            own.append((side, cls, frozenset(shingles)))
        if len(found) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found = []
    if len(own) > 1:
        found += links()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def only(rows: DataFrame, wanted: DataFrame, by: str | list[str]) -> DataFrame:
    """Rows with a value in ``wanted``, which grows with the input: a join by shuffle at any size."""
    return rows.join(wanted.hint("merge"), by, "left_semi")


def bucket_classes(lines: DataFrame) -> DataFrame:
    """key, n, cls, place (written): classes of paragraphs in each bucket of more than one."""
    classes = lines.groupBy("cls").agg(F.min(F.struct("doc_id", "row", "s", "e")).alias("place"), F.first("keys").alias("keys"))
    keyed = cut(classes.select(F.explode("keys").alias("key"), "cls", "place"), "keys")
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    # Written in between: a key of many classes is skewed, which each of the two joins can split on its own.
    out = cut(keyed.join(shared.hint("merge"), "key"), "bucket-classes")
    for done in (keyed, shared):
        drop_cut(done)
    return out


def line_places(members: DataFrame) -> DataFrame:
    return members.select("place.*", "cls", F.lit(True).alias("line")).distinct()


def class_links(members: DataFrame, shingles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b: classes of paragraphs of similarity SIMILARITY or more, enough links to connect all such."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    placed = members.select("key", "cls", "n").withColumn("_c", chunks).withColumn("_m", F.pmod(F.xxhash64("cls", "key"), chunks).cast("int"))
    pair = F.expr("transform(sequence(0, _c - 1), j -> named_struct('pair', least(_m, j) * _c + greatest(_m, j), 'side', case when j = _m then -1 when _m < j then 0 else 1 end))")
    work = placed.withColumn("_p", F.explode(pair)).select("key", F.col("_p.pair").cast("long").alias("pair"), F.col("_p.side").alias("side"), "cls")
    full = work.join(shingles, "cls").select("key", "pair", "side", "cls", "shingles")
    return full.repartition("key", "pair").sortWithinPartitions("key", "pair", "side", "cls").mapInArrow(lambda batches: frugal(_verified(batches)), "a long, b long")


SPAN = ["doc_id", "row", "s", "e", "first_doc_id", "first_s", "size", "removed"]


def repeated_lines(lines: DataFrame, members: DataFrame, detail: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Spans of the paragraphs that are in a cluster of more than one place."""
    links = cut(class_links(members, detail.where("line").select("cls", "shingles"), chunk), "links")
    roots = cut(components(links).select(F.col("node").alias("cls"), "root"), "roots")
    equal = lines.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    wanted = cut(equal.unionByName(roots.select("cls")).distinct(), "repeated-classes")
    own = cut(only(lines.drop("keys"), wanted, "cls"), "repeated").join(roots, "cls", "left")
    own = cut(own.select(F.coalesce("root", "cls").alias("root"), "doc_id", "row", "s", "e"), "members")
    place = F.struct("doc_id", "s", "row")
    clusters = own.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("size")).where("first <> last")
    found = own.join(cut(clusters, "clusters"), "root")
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("s") == F.col("first.s")) & (F.col("row") == F.col("first.row"))
    return found.select("doc_id", "row", "s", "e", F.col("first.doc_id").alias("first_doc_id"), F.col("first.s").alias("first_s"), "size", (~is_first).alias("removed"))


def alike(a: str, b: str) -> Column:
    """How many elements two arrays share from their start."""
    return F.expr(f"coalesce(nullif(array_position(zip_with(slice({a}, 1, least(size({a}), size({b}))), {b}, (x, y) -> coalesce(x = y, false)), false), 0) - 1, least(size({a}), size({b})))")


def run_places(runs: DataFrame) -> DataFrame:
    """Runs (written) whose words occur elsewhere, with the class's first one and whether the stretches to their neighbours are the same there.

    _a, _b: ahead and back; null where the run is not extended, as one that stays or repeats inside its own document.
    """
    own = ["doc_id", "s", *(c for c in runs.columns if c not in ("cls", "doc_id", "s"))]
    place = F.struct("doc_id", "s", "row")
    seen = runs.groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("_l"), F.max(place).alias("_h")).where("_l <> _h").select("cls", "size")
    members = cut(runs.join(cut(seen, "repeated-runs").hint("merge"), "cls"), "runs")
    first = members.groupBy("cls").agg(F.min(F.struct(*own)).alias("first"))
    found = members.join(cut(first, "first-runs"), "cls")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    # What overlaps the first run in its own document is part of what stays.
    found = found.withColumn("removed", ~(same & (F.col("s") < F.col("first.e")) & (F.col("e") > F.col("first.s"))))
    for name, c in (("_a", "ahead"), ("_b", "back")):
        found = found.withColumn(name, F.when(F.col("removed") & ~same, (F.col(c) != 0) & (F.col(c) == F.col(f"first.{c}"))))
    return cut(found, "run-places")


def run_ends(found: DataFrame) -> DataFrame:
    """Places of the runs at the ends of repeated passages, here and at the first one."""
    end = found.where("not _a or not _b")
    places = end.select("doc_id", "row", "s", "e").unionByName(end.select("first.doc_id", "first.row", "first.s", "first.e"))
    return places.select("*", F.lit(0).cast("long").alias("cls"), F.lit(False).alias("line")).distinct()


def repeated_runs(found: DataFrame, detail: DataFrame) -> DataFrame:
    """Spans of the runs, extended as far as the words around equal those around the first one."""
    near = detail.where("not line").drop("shingles", "cls", "line")
    end = found.where("not _a or not _b").select("doc_id", "row", "s", F.col("first.doc_id").alias("fd"), F.col("first.row").alias("fr"), F.col("first.s").alias("fs")).distinct()
    one = cut(end.join(near, ["doc_id", "row", "s"]), "ends")
    other = near.select(F.col("doc_id").alias("fd"), F.col("row").alias("fr"), F.col("s").alias("fs"), F.col("before").alias("fb"), F.col("after").alias("fa"))
    far = one.join(other, ["fd", "fr", "fs"]).withColumn("_nb", alike("before", "fb")).withColumn("_na", alike("after", "fa"))
    far = cut(far.selectExpr("doc_id", "row", "s", "case when _nb > 0 then before_s[_nb - 1] end as far_s", "case when _na > 0 then after_e[_na - 1] end as far_e"), "far")
    both = found.join(far, ["doc_id", "row", "s"], "left")
    return both.select(
        "doc_id", "row", F.when(F.col("_b"), F.col("back_s")).otherwise(F.coalesce("far_s", "s")).alias("s"), F.when(F.col("_a"), F.col("ahead_e")).otherwise(F.coalesce("far_e", "e")).alias("e"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.s").alias("first_s"), "size", "removed",
    )


def repeated_passages(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Passages that occur again, equal or similar: doc_id, row, start, end, first_doc_id, first_start, cluster_size, removed.

    row is the text's 64-bit hash, which tells texts of one id apart. start and end are code points of the text, the end exclusive. Paragraphs and runs that overlap in a document, or touch
    but for a space, are one passage; first_* and cluster_size are those of its first one. The first place of a
    cluster stays; removed is true for all others. Documents without repeated passages have no row. Null, empty and short
    texts have none; a null doc_id comes first. Equal rows repeat each other's passages but share doc_id and place, so
    they are one row and never repeats of each other; cluster_size counts them all. Other columns are not read; empty input gives no rows.
    """
    rows = named_rows(docs)
    runs, lines = units(rows)
    members, found = bucket_classes(lines), run_places(runs)
    detail = cut(details(rows, cut(line_places(members).unionByName(run_ends(found)), "places")), "details")
    spans = cut(repeated_lines(lines, members, detail, chunk).select(SPAN).unionByName(repeated_runs(found, detail).select(SPAN)), "spans")
    own = Window.partitionBy("doc_id", "row", "removed").orderBy("s", "e")
    ended = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("s") <= ended + 1, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    passage = spans.withColumn("_n", number).groupBy("doc_id", "row", "removed", "_n").agg(F.min(F.struct("s", "first_doc_id", "first_s", "size")).alias("f"), F.max("e").alias("end"))
    known = lambda c: F.when(F.col(c) != LONG_MIN, F.col(c))
    return passage.select(known("doc_id").alias("doc_id"), "row", F.col("f.s").alias("start"), "end", known("f.first_doc_id").alias("first_doc_id"), F.col("f.first_s").alias("first_start"), F.col("f.size").alias("cluster_size"), "removed").distinct()


def without(text: Column, spans: Column) -> Column:
    """Texts less their spans (start, end), in order; some may overlap."""
    def one(text: str | None, cuts: list | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for c in cuts:
            out.append(text[at : max(at, c["start"])])
            at = max(at, c["end"])
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([one(t, c) for t, c in zip(texts, found, strict=True)], dtype=object)

    return run(text, spans)


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed passages cut out of their texts; other columns unchanged. A passage is cut from rows of its doc_id and text alone."""
    i, h, spans_name = fresh(docs, "__id", "__row", "__spans")
    spans = passages.where("removed").groupBy(F.col("doc_id").alias(i), F.col("row").alias(h)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans_name))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    some = F.col(spans_name).isNotNull()
    left = without(F.when(some, F.col("text")), F.col(spans_name))  # other texts don't go to Python
    return joined.withColumn("text", F.when(some, left).otherwise(F.col("text"))).select(docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, short texts, ties and repeated rows as in ``repeated_passages``."""
    return repeated_passages(spread(table(spark, sf_dir, "documents")))
