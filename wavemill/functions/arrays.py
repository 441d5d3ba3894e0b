"""SQL text for arithmetic on arrays of doubles, evaluated inside a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: str, name: str, body: str) -> str:
    """Evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s_, x_) -> s_ + x_)"


def mean(a: str) -> str:
    return f"({total(a)} / size({a}))"


def dot(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (p_, q_) -> p_ * q_)")


def squares(a: str) -> str:
    return f"aggregate({a}, 0D, (s_, x_) -> s_ + x_ * x_)"


def leaky(y: str, decay: float, gain: float = 1.0, start: float = 0.0) -> Column:
    """Column of the running s = decay * s + gain * y, which starts from ``start``; for an array of any length.

    Inside blocks of 256 the sums are one product with a triangle of powers; only the blocks' ends follow each other.
    """
    size = 256
    k = np.arange(size)
    triangle = np.where(k[:, None] >= k[None, :], float(decay) ** np.maximum(0, k[:, None] - k[None, :]), 0.0)
    powers = float(decay) ** (k + 1)

    def one(y) -> np.ndarray:
        x = np.asarray(y, dtype=float) * gain
        blocks = np.zeros(-(-len(x) // size) * size)
        blocks[: len(x)] = x
        out, last = blocks.reshape(-1, size) @ triangle.T, start
        for row in out:
            row += powers * last
            last = row[-1]
        return out.ravel()[: len(x)]

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda y: None if y is None else one(y))

    return run(y)


def upper_median(a: str) -> str:
    """Middle of the sorted values; the upper of two."""
    return let(f"array_sort({a})", "m_", "m_[cast(floor(size(m_) / 2) as int)]")


def middle_median(a: str) -> str:
    """Middle of the sorted values; the mean of two."""
    return let(f"array_sort({a})", "m_", "case when size(m_) % 2 = 1 then m_[cast(floor(size(m_) / 2) as int)] else (m_[cast(size(m_) / 2 as int) - 1] + m_[cast(size(m_) / 2 as int)]) / 2 end")


def literal(values) -> str:
    """An array of doubles written out."""
    return "array(" + ", ".join(f"{float(v)!r}D" if abs(float(v)) != float("inf") else f"double('{'-' if v < 0 else ''}Infinity')" for v in values) + ")"


def bound(y: str, body) -> str:
    """``body`` of a name that stands for the value of ``y``.

    The optimizer may put an expression in the place of a column; inside a lambda it would be evaluated at every step.
    """
    return let(y, "y_", body("y_"))
