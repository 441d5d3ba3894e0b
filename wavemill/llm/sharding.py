"""Sharding by minimax contiguous partition (DataFrame operations only).

Atomic groups (equal texts) stand in the order of a 64-bit hash of the text. The smallest capacity for which a greedy
pass needs at most ``shards`` shards is found by binary search; the shards are then cut within that capacity. The
order is by hash, so a cut is one hash value and a row finds its shard by comparing its hash with the cuts:
no join. The driver never sees the groups: it holds sums over ranges of the hash, and only the ranges in which a cut
can lie are split further, until the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_MAX, cut, table

#: Bits of the hash that name a range at first, and by which a range is split each time.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows to a piece for numbering slots, and the most pieces of a shard.
PIECE_ROWS, MOST_PIECES = 250, 4096


class Ranges:
    """Consecutive hash ranges: (low, bits, bytes, largest group, groups), in order, empty ones left out."""

    def __init__(self, entries: list[tuple[int, int, int, int, int]]):
        self.entries = sorted(entries)
        self.ends = [0]
        for e in self.entries:
            self.ends.append(self.ends[-1] + e[2])
        self.total = self.ends[-1]

    def exact(self, at: int) -> bool:
        """Whether the range holds one group, so that no cut lies inside it."""
        return self.entries[at][4] == 1 or self.entries[at][1] == 64

    def reach(self, start: int, capacity: int) -> int:
        """The furthest known group end within ``capacity`` of the position ``start``."""
        return self.ends[bisect_right(self.ends, start + capacity) - 1]

    def reach_at_best(self, start: int, capacity: int) -> int:
        """The furthest position that an unknown group end could have within ``capacity`` of ``start``."""
        at = bisect_right(self.ends, start + capacity) - 1
        if at < len(self.entries) and not self.exact(at):
            return start + capacity
        return self.ends[at]

    def path(self, capacity: int, shards: int, reach) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(reach(out[-1], capacity))
        return out

    def least(self, shards: int, low: int, reach) -> int:
        """Binary search for the smallest capacity, ``low`` at least, for which the greedy pass covers all."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.path(mid, shards, reach)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def range_sums(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Sums over hash ranges named by their first ``bits`` bits, over the wider ranges ``within`` only if given."""
    shift = 64 - bits
    if within is not None:
        names: dict[int, list[int]] = {}
        for low, b in within:
            names.setdefault(b, []).append(low >> (64 - b))
        any_of = F.lit(False)
        for b, lows in names.items():
            any_of = any_of | F.shiftright("h", 64 - b).isin(lows)
        groups = groups.where(any_of)
    found = groups.groupBy(F.shiftright("h", shift).alias("r")).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["r"] << shift, bits, r["s"], r["m"], r["n"]) for r in found]


def find_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and for each shard but the first the first hash that belongs to it.

    ``groups``: h (distinct longs), bytes (positive longs).
    """
    ranges = Ranges(range_sums(groups, FIRST_BITS))
    if not ranges.entries:
        return 0, [LONG_MAX] * (shards - 1)
    least = max(max(e[3] for e in ranges.entries), -(-ranges.total // shards))
    while True:
        high = ranges.least(shards, least, ranges.reach)
        low = ranges.least(shards, least, ranges.reach_at_best)
        if low == high:
            break
        # A cut lies between the cautious path at the lowest capacity and the hopeful path at the highest.
        first, last = ranges.path(low, shards, ranges.reach), ranges.path(high, shards, ranges.reach_at_best)
        open_ranges = {
            k for a, b in zip(first[1:], last[1:], strict=True)
            for k in range(max(0, bisect_right(ranges.ends, a) - 1), min(len(ranges.entries), bisect_right(ranges.ends, b)))
            if not ranges.exact(k)
        }
        if not open_ranges:
            break
        finer: list[tuple[int, int, int, int, int]] = [e for k, e in enumerate(ranges.entries) if k not in open_ranges]
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for k in open_ranges:
            e = ranges.entries[k]
            by_bits.setdefault(e[1], []).append((e[0], e[1]))
        for bits, within in by_bits.items():
            finer += range_sums(groups, min(64, bits + MORE_BITS), within)
        ranges = Ranges(finer)
    # Latest starts from which the rest still fits, so that even cuts stay within the capacity.
    latest = [ranges.total]
    for _ in range(shards):
        at = bisect_right(ranges.ends, latest[-1] - high - 1)
        latest.append(ranges.ends[min(at, len(ranges.ends) - 1)])
    start, cuts = 0, []
    for k in range(1, shards):
        rest = shards - k
        target = start + round((ranges.total - start) / (rest + 1))
        at = bisect_right(ranges.ends, target) - 1
        if at + 1 < len(ranges.ends) and ranges.ends[at + 1] - target < target - ranges.ends[at]:
            at += 1
        end = min(max(ranges.ends[at], latest[rest]), ranges.reach(start, high))
        at = bisect_right(ranges.ends, end) - 1
        cuts.append(ranges.entries[at][0] if at < len(ranges.entries) else LONG_MAX)
        start = end
    return high, cuts


def shard_of(h: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when((h >= F.lit(c)) & F.lit(c != LONG_MAX), 1).otherwise(0)
    return out.cast("int")


def numbered(rows: DataFrame, shard: str, shards: int, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap, in pieces of bounded size.

    A shard's rows are dealt to pieces by a hash of ``order``; a piece is numbered by one task, and the
    pieces' offsets are a table of at most shards * MOST_PIECES rows, so it can be broadcast at any input size.
    """
    most = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, min(MOST_PIECES, most // PIECE_ROWS))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    counts = rows.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_s"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(shard, "_piece").orderBy(*order))
    joined = rows.withColumn("_k", number).join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return joined.withColumn(slot, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_piece", "_s", "_p", "_before", "_k")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law is "bytes".

    size: UTF-8 bytes of the text plus 8. Null and empty texts have 8 bytes, checksum 0, and form one group. Equal texts
    share a shard (texts whose 64-bit hashes agree travel together too). With fewer groups than shards some shards are
    empty. Repeated rows and null ids are rows like any other and get slots of their own. grown_shard is null:
    this law moves rows freely when the number of shards changes. Other columns are not read; empty input gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "sizes")
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = find_cuts(groups, shards)
    placed = numbered(rows.withColumn("shard", shard_of(F.col("h"), cuts)), "shard", shards, ["doc_id", "h", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """The whole table; nulls, empty texts, ties and repeated rows as in ``shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents"))
