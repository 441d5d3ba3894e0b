"""Quality classifier by importance resampling.

Two generative models of hashed n-grams: of the target (texts labelled good) and of the raw corpus (all texts). A
text's log weight is the sum of the log ratios of its n-grams. Sampling without replacement by these weights is
Gumbel top-k: a seeded Gumbel variate is added to each log weight and the k largest sums stay, exactly k of them. k is
the caller's: a number or a share of the rows. Without either it is the number of good texts that the corpus is expected to
hold: the sum over all texts of the odds, fitted on held-out labels, that a text of such a weight is good.

The n-grams are words, word pairs, and pairs of word shapes marked when a word repeats, each in hash buckets of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, frugal, rank_threshold, small_batches, spread, table

#: Hash buckets of each of the three kinds of n-grams.
BUCKETS = 1 << 14
#: Labelled rows that fit the target and the odds at most, taken by a hash of their id; half of them for each.
MOST_LABELLED = 40_000
#: A good text counts so many times in the odds; their ridge penalty; pseudo-count of a bucket.
GOOD_COUNTS, RIDGE, PSEUDO = 4, 1e-3, 0.5
SEED = 11

_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"a"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^Aa9])\1+"), rb"\1\1"))


class _Words(dict):
    """Numbers words in order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


class Grams:
    """Bucket numbers of a text's n-grams; remembers words, up to a number."""

    def __init__(self, buckets: int = BUCKETS, remember: int = 150_000):
        self.buckets, self.remember = buckets, remember
        self.forget()

    def forget(self) -> None:
        self.known, self.done = _Words(), 0
        self.word, self.shape = np.zeros(1 << 14, dtype=np.uint64), np.zeros(1 << 14, dtype=np.uint64)

    def _learn(self) -> None:
        import xxhash

        fresh = list(islice(reversed(self.known), len(self.known) - self.done))[::-1]
        if not fresh:
            return
        while len(self.known) > len(self.word):
            self.word, self.shape = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.shape))
        shapes = fresh
        for pattern, to in _SHAPES:
            shapes = [pattern.sub(to, w) for w in shapes]
        digest = xxhash.xxh64_intdigest
        self.word[self.done : len(self.known)] = np.fromiter((digest(w.lower()) for w in fresh), dtype=np.uint64, count=len(fresh))
        self.shape[self.done : len(self.known)] = np.fromiter((digest(w) for w in shapes), dtype=np.uint64, count=len(fresh))
        self.done = len(self.known)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.remember:
            self.forget()
        number = self.known.__getitem__
        numbers = [np.array(list(map(number, t.split())), dtype=np.int64) for t in texts]
        self._learn()
        n, out = np.uint64(self.buckets), []
        for at in numbers:
            w, s = self.word[at], self.shape[at]
            pair = mixed(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
            again = (at[:-1] == at[1:]).astype(np.uint64)
            form = mixed(s[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[1:] * np.uint64(3) + again)
            out.append(np.concatenate([w % n, n + pair % n, n + n + form % n]).astype(np.int64))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    raw, target = np.zeros(3 * BUCKETS, dtype=np.int64), np.zeros(3 * BUCKETS, dtype=np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            for found, good in zip(grams.of([t or b"" for t in part.column(0).to_pylist()]), part.column(1).to_pylist(), strict=True):
                n = np.bincount(found, minlength=3 * BUCKETS) if len(found) > 2000 else None
                if n is None:
                    np.add.at(raw, found, 1)
                    if good:
                        np.add.at(target, found, 1)
                else:
                    raw += n
                    if good:
                        target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def labelled(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """_id, _good, _fold of at most ``most`` labelled documents; conflicting labels count as not good."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), (F.col("q") > 0).alias("_good"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("_fold"))


def log_ratios(docs: DataFrame, chosen: DataFrame) -> np.ndarray | None:
    """log p_target - log p_raw of each bucket. Raw counts are over all texts; None if no text is a target."""
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    good = F.coalesce(F.col("_good") & (F.col("_fold") == 0), F.lit(False))
    counts = marked.select("_text", good.alias("good")).mapInArrow(lambda batches: frugal(_count(batches)), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = counts.collect()  # a row a bucket
    raw, target = np.zeros(3 * BUCKETS), np.zeros(3 * BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return None
    out = np.zeros(3 * BUCKETS)
    for k in range(3):  # each kind of n-gram is a distribution of its own
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        share = target[own].sum() / max(1.0, raw[own].sum())
        # The raw counts shrink the target's towards them where there is little to go by.
        out[own] = np.log(target[own] + PSEUDO + share) - np.log(raw[own] * share + PSEUDO + share)
    return out


def log_weight(ratios: np.ndarray) -> Column:
    """A column function of ``text``: the sum of its n-grams' log ratios."""

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def work() -> Iterator[pd.Series]:
            grams = Grams()
            for texts in batches:
                out = np.zeros(len(texts))
                for k in range(0, len(texts), 512):
                    for j, found in enumerate(grams.of([bytes(t) if t is not None else b"" for t in texts.iloc[k : k + 512]])):
                        out[k + j] = ratios[found].sum()
                yield pd.Series(out)

        return frugal(work())

    return weigh(F.col("text").cast("binary"))


def gumbel(seed: int = SEED) -> Column:
    """A Gumbel variate from a hash of doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def sortable(key: Column) -> Column:
    """A long that falls as the key rises, in steps of 2**-30."""
    return -F.floor(key * F.lit(float(1 << 30))).cast("long")


def odds(held: DataFrame) -> tuple[float, float] | None:
    """a, b of the odds exp(a + b * log_weight) that a text is good: ridge regression on held-out texts (log_weight, _good).

    None without good or without other labels. The rows collected are the second fold's, MOST_LABELLED at most.
    """
    rows = held.select("log_weight", "_good").collect()
    w, good = np.array([r["log_weight"] for r in rows], dtype=float), np.array([bool(r["_good"]) for r in rows])
    if not good.any() or good.all():
        return None
    scale = max(float(np.median(np.abs(w))), 1e-9)
    x, count, beta = np.stack([np.ones(len(w)), w / scale], axis=1), np.where(good, GOOD_COUNTS, 1.0), np.zeros(2)
    for _ in range(50):  # Newton's method, damped
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (count * (good - p)) - RIDGE * len(w) * beta
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + RIDGE * len(w) * np.eye(2), slope)
        beta = beta + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return float(beta[0]), float(beta[1] / scale)


def expected_good(rows: DataFrame, held: DataFrame) -> int:
    """How many of ``rows`` (log_weight) are good, by the odds; all without them."""
    line = odds(held)
    if line is None:
        return rows.count()
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(line[0]) + F.lit(line[1]) * F.col("log_weight")))
    return int(round(rows.agg(F.sum(1 / (1 + F.exp(-z)))).first()[0] or 0.0))


def top(rows: DataFrame, k: int, key: str, tie: str) -> Column:
    """Whether a row is one of the k of largest ``key``; of equal ones those of smallest ``tie``, a long that is unique."""
    if k < 1:
        return F.lit(False)
    place = sortable(F.col(key))
    last = rank_threshold(rows.select(place.alias("s")), "s", k)
    if last is None:
        return F.lit(True)
    own = rows.where(place == F.lit(last))
    need = k - rows.where(place < F.lit(last)).count()
    return (place < F.lit(last)) | ((place == F.lit(last)) & (F.col(tie) <= F.lit(rank_threshold(own.select(tie), tie, need))))


def scored(docs: DataFrame, ratios: np.ndarray, weight: str = "log_weight", key: str = "sample_key") -> DataFrame:
    return docs.withColumn(weight, log_weight(ratios)).withColumn(key, F.col(weight) + gumbel())


def second_fold(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(chosen.where("_fold = 1").select("_id", "_good")), F.col("doc_id") == F.col("_id"))


def sampled(docs: DataFrame, labels: DataFrame, k: int | None, share: float | None, weight: str, key: str, tie: str, keep: list[str]) -> tuple[DataFrame, Column] | None:
    """The columns ``keep`` of ``docs`` (written) with three more, and which rows the sample has; None without any good label."""
    small_batches(docs.sparkSession)
    chosen = cut(labelled(labels), "labelled")
    ratios = log_ratios(docs, chosen)
    if ratios is None:
        return None
    rows = cut(scored(docs, ratios, weight, key).select(*keep, weight, key, F.monotonically_increasing_id().alias(tie)), "scored")
    if share is not None:
        k = int(round(share * rows.count()))
    if k is None:
        plain = rows.select("doc_id", F.col(weight).alias("log_weight"))
        k = expected_good(plain, second_fold(plain, chosen))
    return rows, top(rows.select(key, tie), k, key, tie)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of every row.

    Exactly the ``k`` rows, or that ``share`` of them, of the largest keys stay; without either, as many as are expected to
    be good. All stay where there are no more than that. Equal keys are told apart by place. Null and empty texts
    weigh 0. Without any good label everything stays. Repeated rows share their key; a null doc_id draws the variate of
    null. Other columns are not read; empty input gives no rows.
    """
    found = sampled(docs.select("doc_id", "text"), labels, k, share, "log_weight", "sample_key", "_place", ["doc_id"])
    if found is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), gumbel().alias("sample_key"), F.lit(True).alias("kept"))
    rows, kept = found
    return rows.select("doc_id", "log_weight", "sample_key", kept.alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, columns unchanged; nulls, ties and repeated rows as there."""
    weight, key, tie = fresh(docs, "__weight", "__key", "__place")
    found = sampled(docs, labels, k, share, weight, key, tie, docs.columns)
    return docs if found is None else found[0].where(found[1]).select(docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts, ties and repeated rows as in ``classify``."""
    return classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
