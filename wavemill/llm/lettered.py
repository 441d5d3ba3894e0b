"""Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as bytes; and ranks over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A-Z lower-cased, and every character that is in no word a space.
_CLEAN = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a long text whose words are listed in one go.
PIECE = 1 << 20


def lettered(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    clean, at = text.translate(_CLEAN), 0
    while len(clean) - at > piece:
        end = clean.find(b" ", at + piece)
        if end < 0:
            break
        yield clean[at:end].split()
        at = end
    yield clean[at:].split()


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (written) with ``name``, their place from 1 in that order over the whole table.

    The rows are dealt by ranges of the order and numbered where they lie; only the sizes of the ranges come to the driver.
    """
    place = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in sorted(place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["part"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    return place.join(F.broadcast(first), part == F.col("_part")).select(*(F.col(c) for c in rows.columns), (F.col("_before") + within + 1).alias(name))
