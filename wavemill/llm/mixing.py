"""Mixing sources to target weights by subset-sum budget fitting.

The documents are counted by source and exact size. For each source the budget is met in three parts: whole
copies of the source, then a share of every size by error diffusion, then a bounded-knapsack dynamic programme that
fills the small rest exactly. The plan says how many documents of each (source, size) get one copy more; the
documents themselves are chosen by a seeded hash, in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_MIN, cut, fresh, sized, table, words_count

#: A source is never repeated more often than this.
MOST_COPIES = 3
#: Words that the dynamic programme fills, besides what error diffusion is off by.
DP_WORDS = 8192
#: Rows to a piece when documents of one source and size are chosen, and the most pieces of such a group.
PIECE_ROWS, MOST_PIECES = 250, 65536


def targets(sizes: list[int], weights: list[float], most: int = MOST_COPIES) -> list[float]:
    """Each source's words: shares of the total by weight, stopped at ``most`` times its size, the excess reshared."""
    out, total = [0.0] * len(sizes), float(sum(sizes))
    open_, left = [k for k in range(len(sizes))], total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, ``counts`` at most, for the largest sum up to ``budget``: bounded knapsack.

    The reachable sums are one bit set; items of a length come in powers of two.
    """
    take = [0] * len(lengths)
    if budget <= 0:
        return take
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count = min(count, budget // length) if length else 0
        part = 1
        while count > 0:
            n = min(part, count)
            steps.append((reach, k, n))
            reach = (reach | (reach << (n * length))) & mask
            count, part = count - n, part * 2
        if reach >> budget:
            break
    at = reach.bit_length() - 1
    for before, k, n in reversed(steps):
        if not before >> at & 1:
            at -= n * lengths[k]
            take[k] += n
    return take


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST_COPIES) -> tuple[int, np.ndarray]:
    """Copies that every document gets, and how many documents of each length get one more."""
    extra = np.zeros(len(lengths), dtype=np.int64)
    total, budget = int((lengths * counts).sum()), int(round(target))
    if not total:
        return 0, extra
    copies = min(most, budget // total)
    rest = budget - copies * total
    if copies == most or rest <= 0:
        return copies, extra
    aim = max(0, rest - DP_WORDS)
    order = np.argsort(-lengths, kind="stable")
    seen = taken = 0
    for k in order:
        length, count = int(lengths[k]), int(counts[k])
        if not length:
            continue
        seen += length * count
        n = max(0, min(count, round((aim * seen // total - taken) / length)))
        extra[k], taken = n, taken + n * length
    left = rest - taken
    small = [int(k) for k in order if 0 < lengths[k] <= left and counts[k] > extra[k]]
    for k, n in zip(small, fill([int(lengths[k]) for k in small], [int(counts[k] - extra[k]) for k in small], left), strict=True):
        extra[k] += n
    return copies, extra


def source_targets(rows: DataFrame, weights: dict | None = None) -> DataFrame:
    """_src (number), source, source_size, target of each source.

    The list of sources comes to the driver: it names the mix's parts, for each of which someone set a weight.
    Without ``weights`` sources weigh 1, 2, 3, repeating, by code point of their name, null last.
    """
    found = [(r["source"], r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    w = [float(k % 3 + 1) if weights is None else float(weights.get(name, 0.0)) for k, (name, _) in enumerate(found)]
    out = [(k, name, int(s), t) for k, ((name, s), t) in enumerate(zip(found, targets([x[1] for x in found], w), strict=True))]
    # As an Arrow table it needs no task; a list of rows would start two Python workers more beside each executor.
    kinds = {"_src": pa.int32(), "source": pa.string(), "source_size": pa.int64(), "target": pa.float64()}
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return rows.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)), "_src int, source string, source_size long, target double")


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    copies, extra = plan_source(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]))
    return pd.DataFrame({"_src": pdf["_src"], "size": pdf["size"], "_n": pdf["n"], "_copies": copies, "_extra": extra})


def planned(rows: DataFrame, of: DataFrame) -> DataFrame:
    """_src, source, size, _n, _copies, _extra (written) of each source and size of ``rows``; ``of``: source_targets."""
    named = of.withColumnRenamed("source", "_name")
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).join(named, F.col("source").eqNullSafe(F.col("_name")))
    # A source's histogram is one group: as many rows as it has distinct sizes, not documents.
    plan = hist.select("_src", "size", "n", "target").groupBy("_src").applyInPandas(_plan, "_src int, size long, _n long, _copies int, _extra long")
    return cut(plan.join(F.broadcast(of.select("_src", "source")), "_src"), "plan")


def pieces() -> Column:
    """Pieces that a source and size is drawn in, by its rows."""
    return F.least(F.lit(MOST_PIECES), F.greatest(F.lit(1), (F.col("_n") / PIECE_ROWS).cast("int")))


def choose(rows: DataFrame, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """``rows`` (doc_id, source, size, any others) with source_size, target and copies, the times each is taken."""
    of = source_targets(rows, weights).cache()
    keyed = rows.join(of.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    planned_rows = keyed.join(planned(rows, of).drop("source"), ["_src", "size"]).withColumn("_u", draw).withColumn("_piece", F.pmod("_u", pieces()).cast("int"))
    counts = planned_rows.where("_extra > 0 and _extra < _n").groupBy("_src", "size", "_piece").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_src", "size").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    number = F.row_number().over(Window.partitionBy("_src", "size", "_piece").orderBy("_u", "doc_id"))
    numbered = planned_rows.withColumn("_k", number).join(counts, ["_src", "size", "_piece"], "left")
    more = F.when(F.col("_extra") >= F.col("_n"), 1).when(F.coalesce("_before", F.lit(0)) + F.col("_k") <= F.col("_extra"), 1).otherwise(0)
    return numbered.withColumn("copies", (F.col("_copies") + more).cast("int")).drop("_src", "_n", "_copies", "_extra", "_u", "_piece", "_k", "_before")


def mix(docs: DataFrame, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    size: words of the text, null and empty having none. A null source is a source of its own, the last. A source
    without words has target 0. Documents of one source and size are drawn by a hash of doc_id, so reruns agree;
    rows that share doc_id, source and size are alike and any of them may be the one taken. Other columns are not read;
    empty input gives no rows.
    """
    rows = cut(docs.select("doc_id", "source", words_count(F.col("text")).alias("size")), "sized")
    return choose(rows, seed, weights).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def last_draws(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """_src, size, _last, _m, _k: of each source and size some of whose rows get a copy more, the last draw that does.

    Of the _m rows with just that draw _k get one. ``rows``: source, size, u. Counts by ranges of the draw find the
    range in which the last one lies, and only its rows are looked at one by one.
    """
    some = plan.where("_extra > 0 and _extra < _n").withColumnRenamed("size", "_size").withColumnRenamed("source", "_name")
    at = F.floor((F.shiftrightunsigned(F.col("u").bitwiseXOR(F.lit(LONG_MIN)), 11) / F.lit(float(1 << 53))) * pieces()).cast("int")
    keyed = rows.join(sized(some), F.col("source").eqNullSafe(F.col("_name")) & (F.col("size") == F.col("_size"))).select("_src", "size", "u", "_extra", at.alias("_piece"))
    before = Window.partitionBy("_src", "size").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_src", "size", "_extra", "_piece").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before.orderBy("_piece")), F.lit(0)))
    edge = cut(counts.where("_before < _extra and _before + _c >= _extra").select("_src", "size", "_piece", "_before"), "edges")
    fine = keyed.join(sized(edge), ["_src", "size", "_piece"]).groupBy("_src", "size", "_extra", "_before", "u").agg(F.count(F.lit(1)).alias("_m"))
    fine = fine.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(before.orderBy("u")), F.lit(0)))
    return fine.where("_before < _extra and _before + _m >= _extra").select("_src", "size", F.col("u").alias("_last"), "_m", (F.col("_extra") - F.col("_before")).alias("_k"))


def mixed_documents(docs: DataFrame, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each as often as it is taken, columns unchanged.

    A document without words gets its source's whole copies. A row repeated in full counts as often as it is there, in
    the sizes and in the mix. A null doc_id is like any other. A row's draw is a hash of all its columns (maps left
    out), so a table of the last draws decides where the row is: no text is shuffled, but for repeated rows of which
    only some are taken.
    """
    z, u, n, name = fresh(docs, "__size", "__u", "__copy", "__source")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumn(z, words_count(F.col("text"))).withColumn(u, F.xxhash64(F.lit(seed), *plain))
    rows = cut(keyed.select("source", F.col(z).alias("size"), F.col(u).alias("u")), "drawn")
    plan = planned(rows, source_targets(rows, weights).cache())
    limits = plan.join(last_draws(rows, plan), ["_src", "size"], "left").where("_copies > 0 or _extra > 0")
    limits = cut(limits.select(F.struct("_n", "_copies", "_extra", "_last", "_m", "_k").alias(n), F.col("source").alias(name), F.col("size").alias(f"{z}_")), "limits")
    joined = keyed.join(sized(limits), F.col("source").eqNullSafe(F.col(name)) & (F.col(z) == F.col(f"{z}_")))
    at = lambda c: F.col(n)[c]
    partly = F.coalesce((F.col(u) == at("_last")) & (at("_k") < at("_m")), F.lit(False))
    more = F.when(at("_extra") >= at("_n"), 1).when(F.col(u) <= at("_last"), 1).otherwise(0)
    copies = (at("_copies") + more).cast("int")
    out = joined.where(~partly & (copies > 0)).withColumn(n, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)
    if limits.where(F.col(f"{n}._k") < F.col(f"{n}._m")).limit(1).count():
        once = joined.where(partly).dropDuplicates([u, name, z])
        total = at("_copies") * at("_m") + at("_k")
        dealt = once.withColumn(f"{n}_", F.explode(F.expr(f"sequence(1L, {n}._copies * {n}._m + {n}._k, {MOST_PIECES}L)"))).repartition(u, f"{n}_")
        last = F.least(total, F.col(f"{n}_") + (MOST_PIECES - 1))
        out = out.unionByName(dealt.withColumn(n, F.explode(F.sequence(F.col(f"{n}_"), last))).select(docs.columns))
    return out


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts, repeated rows and ties as in ``mix``."""
    return mix(table(spark, sf_dir, "documents"))
