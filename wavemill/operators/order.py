"""Order statistics of groups of any size by merging counts.

Equal values of a group become one row with a count where they are read. These rows are dealt by ranges of group and value, each task adds up the counts of
what it holds, and the sums of the ranges before it, a row a range and group, give every value's exact place in its group. A group
is never sorted in one task, and any number of places is looked up in one pass over the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.blocks import typed
from wavemill.operators.lineage import cut


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def placed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before): each value of a group, how many rows have it and how many a smaller one. Null values are left out; a null group is a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    names = [*by, value]
    dealt = counts.repartitionByRange(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in range(len(by)):
                new[1:] |= np.diff(_codes(batch.column(k))) != 0
            first = tuple(batch.column(k)[0].as_py() for k in range(len(by)))
            new[0] = first != last
            n = batch.column(len(names)).to_numpy()
            total = np.cumsum(n) - n
            starts = np.flatnonzero(new)
            base = np.full(batch.num_rows, -carry, dtype=np.int64)  # of the group that goes on from the batch before
            if len(starts):
                base[starts[0] :] = np.repeat(total[starts], np.diff(np.r_[starts, batch.num_rows]))
            inside = total - base
            last, carry = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(len(by))), int(inside[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], batch.column(len(names)), pa.array(inside)], names=[*names, "n", "inside_"])

    local = cut(dealt.mapInArrow(run, f"{typed(counts, names)}, n long, inside_ long").withColumn("part_", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*by, "part_").agg(F.sum("n").alias("s_")).withColumn("off_", F.coalesce(F.sum("s_").over(earlier), F.lit(0)))
    keyed = sums.select(*(F.col(c).alias(f"k{k}_") for k, c in enumerate(by)), F.col("part_").alias("p_"), "off_")
    same = [F.col(c).eqNullSafe(F.col(f"k{k}_")) for k, c in enumerate(by)]
    joined = local.join(keyed, [F.col("part_") == F.col("p_"), *same])
    return joined.select(*names, "n", (F.col("off_") + F.col("inside_")).alias("before"))


def at(places: DataFrame, by: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """(by, n_, names...): the values at places (from 0, columns of the group's size n_) of groups placed before."""
    sizes = places.groupBy(*by).agg(F.sum("n").alias("n_"))
    keyed = sizes.select(*(F.col(c).alias(f"k{k}_") for k, c in enumerate(by)), "n_")
    joined = places.join(keyed, [F.col(c).eqNullSafe(F.col(f"k{k}_")) for k, c in enumerate(by)])
    here = lambda place: F.max(F.when((place >= F.col("before")) & (place < F.col("before") + F.col("n")), F.col(value)))
    return joined.groupBy(*by).agg(F.first("n_").alias("n_"), *(here(place).alias(name) for name, place in wanted.items()))


def percentiles(places: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, names...): interpolated percentiles of groups placed before."""
    wanted, last = {}, F.col("n_") - 1
    for name, q in shares.items():
        wanted |= {f"{name}_l": F.floor(last * q), f"{name}_h": F.ceil(last * q)}
    found = at(places, by, value, wanted)
    mixed = lambda name, q: F.col(f"{name}_l") + (last * q - F.floor(last * q)) * (F.col(f"{name}_h") - F.col(f"{name}_l"))
    return found.select(*by, *(mixed(name, q).alias(name) for name, q in shares.items()))


def joined_to(rows: DataFrame, found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their group, null groups too."""
    keyed = found.select(*(F.col(c).alias(f"k{k}_") for k, c in enumerate(by)), *names)
    return rows.join(keyed, [F.col(c).eqNullSafe(F.col(f"k{k}_")) for k, c in enumerate(by)]).drop(*(f"k{k}_" for k in range(len(by))))
