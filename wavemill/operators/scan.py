"""Linear recurrences along clips of any length: s[t] = decay * s[t - 1] + gain * x[t].

Over a stretch of values the recurrence is an affine map of the state before it, (a, e): s -> a * s + e. Each block is mapped on its own, the maps are
composed along a clip in two levels, blocks in groups and groups in clips, and each block is then run again from the state that reaches it. No
clip is ever one row, and what one task composes is a pair a block, or a pair a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import column, lists_of, matrix, over_groups, rows_of, typed

#: Steps of a block, blocks of a group.
STEPS, GROUP = 1 << 12, 1 << 12


def running(x: np.ndarray, decay: float, state: np.ndarray) -> np.ndarray:
    """The recurrence down the rows of x from a state of its width; stretches of 256 rows are one product with a triangle of powers."""
    if not len(x):
        return x.copy()
    if decay == 1:
        return np.cumsum(np.concatenate([state[None, :] + x[:1], x[1:]]), axis=0)
    size = min(256, len(x))
    k = np.arange(size)
    triangle = np.where(k[:, None] >= k[None, :], float(decay) ** np.maximum(0, k[:, None] - k[None, :]), 0.0)
    powers = float(decay) ** (k + 1)
    out = np.empty_like(x)
    for at in range(0, len(x), size):
        part = x[at : at + size]
        out[at : at + size] = triangle[: len(part), : len(part)] @ part + powers[: len(part), None] * state
        state = out[at + len(part) - 1]
    return out


def blocks_of(values: DataFrame, keys: list[str], order: str = "t", x: str = "x", steps: int = STEPS) -> DataFrame:
    """(keys, b, t, v): rows of a number or of an array of numbers each, in stretches of ``steps`` along ``order``; t and v are arrays, v flat."""
    found = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("t"), F.col(x).alias("x"))))
    made = values.groupBy(*keys, F.floor(F.col(order) / steps).cast("long").alias("b")).agg(found.alias("s_"))
    v = "flatten(transform(s_, s -> s.x))" if values.schema[x].dataType.typeName() == "array" else "transform(s_, s -> cast(s.x as double))"
    return made.select(*keys, "b", F.expr("transform(s_, s -> s.t)").alias("t"), F.expr(v).alias("v"))


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and values (steps, width) of each block."""
    t, v = batch.column(batch.schema.get_field_index("t")), batch.column(batch.schema.get_field_index("v"))
    for k in range(batch.num_rows):
        yield k, np.asarray(v[k].values).reshape(len(t[k].values), -1)


def block_maps(blocks: DataFrame, keys: list[str], decay: float, gain: float = 1.0) -> DataFrame:
    """(keys, b, a, e) of every block: where it takes the state before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [running(x * gain, decay, np.zeros(x.shape[1]))[-1] for _, x in _bodies(batch)]
            sizes = np.array([len(x) for _, x in _bodies(batch)])
            if len(ends):
                kept = [batch.column(batch.schema.get_field_index(n)) for n in (*keys, "b")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(float(decay) ** sizes), rows_of(np.stack(ends))], names=[*keys, "b", "a", "e"])

    return blocks.mapInArrow(run, f"{typed(blocks, keys)}, b long, a double, e array<double>")


def _composed(rows: DataFrame, keys: list[str], by: str, order: str) -> DataFrame:
    """(keys, by, order, a, e, pa, pe): each map with the composition of those before it in its group."""
    names = [*keys, by, order]

    def step(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, e = table.column("a").to_numpy(), matrix(column(table, "e"))
        pa_, pe = np.ones(len(a)), np.zeros_like(e)
        begins = np.zeros(len(a), dtype=bool)
        begins[starts] = True
        for k in range(1, len(a)):
            if not begins[k]:
                pa_[k], pe[k] = a[k - 1] * pa_[k - 1], a[k - 1] * pe[k - 1] + e[k - 1]
        yield pa.RecordBatch.from_arrays([*(column(table, n) for n in names), column(table, "a"), column(table, "e"), pa.array(pa_), rows_of(pe)], names=[*names, "a", "e", "pa", "pe"])

    return over_groups(rows, [*keys, by], order, step, f"{typed(rows, names)}, a double, e array<double>, pa double, pe array<double>")


def states(maps: DataFrame, keys: list[str], start: float = 0.0, initial: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """(keys, b, s): the state before every block, from maps (keys, b, a, e). A clip starts from ``start`` or its row of ``initial`` (keys, s)."""
    inner = _composed(maps.withColumn("g", F.floor(F.col("b") / group).cast("long")), keys, "g", "b")
    # A group's own map is its last block's after the composition of those before.
    last = F.max_by(F.struct((F.col("a") * F.col("pa")).alias("a"), F.expr("zip_with(pe, e, (p, q) -> a * p + q)").alias("e")), "b").alias("m")
    groups = inner.groupBy(*keys, "g").agg(last).select(*keys, "g", "m.a", "m.e").withColumn("one_", F.lit(0))
    outer = _composed(groups, keys, "one_", "g").select(*keys, "g", F.col("pa").alias("qa"), F.col("pe").alias("qe"))
    if initial is None:
        outer = outer.withColumn("s0_", F.lit(None).cast("array<double>"))
    else:
        names = [f"k{n}_" for n in range(len(keys))]
        first = initial.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("s").alias("s0_"))
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
        outer = outer.join(first, same, "left").drop(*names)
    reached = outer.select(*keys, "g", F.expr(f"transform(qe, (e, i) -> qa * coalesce(s0_[i], {start!r}D) + e)").alias("s_"))
    return inner.join(reached, [*keys, "g"]).select(*keys, "b", F.expr("transform(pe, (e, i) -> pa * s_[i] + e)").alias("s"))


def recurrence(blocks: DataFrame, keys: list[str], decay: float, gain: float = 1.0, start: float = 0.0, initial: DataFrame | None = None, before: bool = False, group: int = GROUP) -> DataFrame:
    """``blocks`` (keys, b, t, v) with s, flat like v: the state after each step, or before it.

    Blocks keep the partitioning that made them, so only the maps and the states are shuffled to them. Steps may be missing: the recurrence goes
    from one step that is there to the next.
    """
    reached = states(block_maps(blocks, keys, decay, gain), keys, start, initial, group)
    joined = blocks.join(reached, [*keys, "b"])
    names = [*keys, "b", "t", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = batch.column(batch.schema.get_field_index("s"))
            made = []
            for k, x in _bodies(batch):
                first = np.asarray(state[k].values)
                s = running(x * gain, decay, first)
                made.append((np.concatenate([first[None, :], s[:-1]]) if before else s).ravel())
            if made:
                kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, lists_of(np.concatenate(made), np.array([len(m) for m in made]))], names=[*names, "s"])

    return joined.mapInArrow(run, f"{typed(blocks, names)}, s array<double>")


def final_states(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s): the state after the last step of every clip, to go on from; s is an array as wide as the values."""
    own = F.struct(F.expr("slice(s, greatest(1, size(s) - cast(size(s) / size(t) as int) + 1), cast(size(s) / size(t) as int))").alias("s"))
    return scanned.groupBy(*keys).agg(F.max_by(own, "b").alias("z")).select(*keys, "z.s")


def unrolled(scanned: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """(keys, t, columns...) from blocks of single values; each column is SQL of the lambda variables v and s."""
    made = F.expr("arrays_zip(t, v, s)").alias("z")
    rows = scanned.select(*keys, F.explode(made).alias("z")).select(*keys, F.col("z.t").alias("t"), F.col("z.v").alias("v"), F.col("z.s").alias("s"))
    return rows.select(*keys, "t", *(F.expr(sql).alias(name) for name, sql in columns.items()))
