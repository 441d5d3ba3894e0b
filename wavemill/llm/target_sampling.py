"""Target-distribution importance resampling by external sort-count.

One pass writes the hash buckets of every text's runs of one to three words as packed uint16 streams, with the place at
which each document begins. The streams are sorted block by block and run-length encoded, and the runs merged by a sum, which gives the counts
of the corpus and in the same way of the target. The gains of the 10,000 buckets then go over the streams once more:
a document's weight is ``np.add.reduceat`` over what its buckets gain. Texts are read once, and no word is hashed twice.

The CRC-32 of a run comes from those of its words: appending a word to a prefix is a linear map of the prefix's
checksum, given by the word's length, and an exclusive or with the word's own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, frugal, sized, table
from .lettered import lettered, ranked

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Words of a document that make it eligible, and percent of the eligible that are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Words of a block: what is written, sorted and gathered in one go. A longer document is a block of its own.
BLOCK = 1 << 14
#: Words that a Python worker remembers the checksums of.
REMEMBER = 200_000

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


class Appending:
    """The checksum of a || b from those of a and b, for arrays: four look-ups by the bytes of a's in a table for b's length."""

    #: Lengths with a table of their own.
    SHORT = 48

    def __init__(self) -> None:
        value = np.arange(256, dtype=np.uint32)
        step = np.concatenate([value << np.uint32(8 * k) for k in range(4)])  # no byte appended
        tables, self.powers = [step], []
        for _ in range(self.SHORT):
            step = self._zero(step)
            tables.append(step)
        self.tables = np.concatenate(tables)

    @staticmethod
    def _zero(x: np.ndarray) -> np.ndarray:
        return _TABLE[x & np.uint32(255)] ^ (x >> np.uint32(8))

    @staticmethod
    def _look(tables: np.ndarray, base: np.ndarray | int, x: np.ndarray) -> np.ndarray:
        out = tables[base + (x & np.uint32(255))]
        for k in (1, 2, 3):
            out ^= tables[base + 256 * k + ((x >> np.uint32(8 * k)) & np.uint32(255))]
        return out

    def _power(self, k: int) -> np.ndarray:
        """The table for 2**k bytes."""
        while len(self.powers) <= k:
            last = self.powers[-1] if self.powers else self.tables[1024:2048]
            self.powers.append(self._look(last, 0, last) if self.powers else last)
        return self.powers[k]

    def __call__(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self._look(self.tables, np.minimum(length, self.SHORT) * 1024, a)
        for at in np.flatnonzero(length > self.SHORT).tolist():
            x, n = a[at : at + 1], int(length[at])
            for k in range(n.bit_length()):
                if n >> k & 1:
                    x = self._look(self._power(k), 0, x)
            out[at] = x[0]
        return out ^ b


class _Numbers(dict):
    """Numbers words in order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


class Features:
    """Buckets of the runs of words of texts, and the number of runs of each text."""

    def __init__(self, buckets: int = BUCKETS, remember: int = REMEMBER):
        self.buckets, self.remember, self.append = np.uint32(buckets), remember, Appending()
        self.forget()

    def forget(self) -> None:
        self.known, self.done = _Numbers(), 0
        self.crc, self.spaced, self.length = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.int64)

    def numbers(self, text: bytes) -> np.ndarray:
        number = self.known.__getitem__
        return np.concatenate([np.array(list(map(number, words)), dtype=np.int64) for words in lettered(text)])

    def _learn(self) -> None:
        new = list(islice(reversed(self.known), len(self.known) - self.done))[::-1]
        while len(self.known) > len(self.crc):
            self.crc, self.spaced, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.crc, self.spaced, self.length))
        own = slice(self.done, len(self.known))
        self.crc[own] = np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
        self.spaced[own] = np.fromiter((zlib.crc32(w + b" ") for w in new), np.uint32, len(new))
        self.length[own] = np.fromiter(map(len, new), np.int64, len(new))
        self.done = len(self.known)

    def of(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The packed stream of the texts with these words, text by text, and how many runs each has."""
        self._learn()
        at, sizes = np.concatenate([*numbers, np.zeros(0, np.int64)]), np.array([len(x) for x in numbers], dtype=np.int64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(at))  # words from here to the text's end
        crc, length = self.crc[at], self.length[at]
        out = np.zeros((len(at), LONGEST), dtype=np.uint16)
        out[:, 0] = crc % self.buckets
        if len(at) > 1:
            spaced = self.spaced[at]
            out[:-1, 1] = self.append(spaced[:-1], crc[1:], length[1:]) % self.buckets
            if len(at) > 2:
                two = self.append(spaced[:-2], spaced[1:-1], length[1:-1] + 1)
                out[:-2, 2] = self.append(two, crc[2:], length[2:]) % self.buckets
        runs = sizes + np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)
        return out[np.arange(LONGEST) < left[:, None]], runs


#: A block: ids and row hashes of its documents, the place in the stream at which each begins, its end last, and the stream.
STREAM = "ids array<long>, hashes array<long>, starts array<long>, stream binary"


def streams(docs: DataFrame, key: str, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The packed bucket streams of all texts (written)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        ids, hashes, held, words = [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream, runs = features.of(held)
            starts = np.r_[0, np.cumsum(runs)]
            if len(features.known) > features.remember:
                features.forget()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([hashes], pa.list_(pa.int64())), pa.array([starts]), pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["ids", "hashes", "starts", "stream"])

        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = features.numbers(text.as_py() or b"")
                if held and words + len(found) > block:
                    yield flush()  # knows the words met since, whose numbers stay until the memory is cleared
                    ids, hashes, held, words = [], [], [], 0
                    if not features.known:
                        found = features.numbers(text.as_py() or b"")
                ids.append(i)
                hashes.append(h)
                held.append(found)
                words += len(found)
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    return cut(rows.mapInArrow(lambda batches: frugal(work(batches)), STREAM), "streams")


def _runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block sorted and run-length encoded; the runs of a task are added up before they leave it."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for stream in batch.column(0):
            values = np.sort(np.frombuffer(stream.as_py(), dtype="<u2"), kind="stable")  # a radix sort at this width
            edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
            total[values[edges[:-1]]] += np.diff(edges)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; a row a bucket comes to the driver."""
    runs = blocks.select("stream").mapInArrow(lambda batches: frugal(_runs(batches, buckets)), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel_step(i: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate from the SHA-256 of seed and id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _gathered(batches: Iterator[pa.RecordBatch], gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, hashes = batch.column(0)[k].values, batch.column(1)[k].values
            starts = batch.column(2)[k].values.to_numpy()
            own, sizes = gains[np.frombuffer(batch.column(3)[k].as_py(), dtype="<u2")], np.diff(starts)
            weight = np.zeros(len(sizes), dtype=np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                weight[some] = np.add.reduceat(own, starts[:-1][some])
            noise = np.fromiter((gumbel_step(i, seed) for i in ids.to_pylist()), np.int64, len(weight))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "row", "n_features", "weight", "score"])


def enough(least_words: int) -> Column:
    """Whether a text has so many words, by its number of features."""
    return F.col("n_features") >= sum(max(least_words - k, 0) for k in range(LONGEST))


def scores(docs: DataFrame, target: DataFrame, key: str = "doc_id", target_key: str | None = None, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, row (a hash of the text), n_features, weight, score of every row (written)."""
    blocks = streams(docs, key, buckets)
    aim = target.select(F.lit(0).cast("long").alias("_key"), "text")
    gains = gains_of(bucket_counts(blocks, buckets), bucket_counts(streams(aim, "_key", buckets), buckets))
    schema = "doc_id long, row long, n_features long, weight long, score long"
    return cut(blocks.mapInArrow(lambda batches: frugal(_gathered(batches, gains, seed)), schema), "scores")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, row (a hash of the text), n_features, weight, score, rank of every row; rank is null for what isn't drawn.

    ``percent`` of the rows of ``least_words`` words and more are drawn, rounded down: those of highest score, ties to the smaller doc_id, a null
    one first; of repeated rows at the last place some are drawn. Null and empty texts have no features and weigh 0. An empty target gains nothing
    but the smoothing. A text is one row of a stream, hence at most about 300 million words. Other columns are not read; empty input gives no rows.
    """
    rows = scores(docs, target, buckets=buckets, seed=seed)
    eligible = rows.where(enough(least_words))
    drawn = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("row")]
    placed = ranked(eligible, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(rows.where(~enough(least_words)).withColumn("rank", F.lit(None).cast("long")))


def resampled_documents(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged; rows equal in id and text as the last one drawn stay together."""
    i, h = fresh(docs, "__id", "__row")
    drawn = cut(resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(i), F.col("row").alias(h)).distinct(), "drawn")
    return docs.join(sized(drawn), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_semi")


def op11_target_sampling(spark, sf_dir: str) -> DataFrame:
    """All documents towards all benchmark texts; nulls, short texts, ties and repeated rows as in ``resample``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is linear: a byte k bytes before the end adds what 8 * (k + 1) steps of the shift register make of it, and the
#: start value what they make of 2**32 - 1.
OP11_SQL = """
with recursive w as (
    select 'd' as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws, row_number() over () as r from documents
    union all
    select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), row_number() over () from benchmark
),
placed as (select side, r, doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as a from w),
runs as (select side, r, i, a, lead(a) over o as b, lead(a, 2) over o as c from placed window o as (partition by side, r order by i)),
f as (select side, r, a as f from runs union all select side, r, a || ' ' || b from runs where b is not null union all select side, r, a || ' ' || b || ' ' || c from runs where c is not null),
per as (select side, r, f, count(*) as n from f group by all),
words as (select f, hex(encode(f)) as x, octet_length(encode(f)) as len from (select distinct f from per)),
reg as (
    select 0 as k, b, case when b < 256 then b::uinteger else 4294967295::uinteger end as v from range(257) t(b)
    union all
    select k + 1, b, v from (
        select k, b, case when v7 & 1 = 1 then xor(v7 >> 1, 3988292384::uinteger) else v7 >> 1 end as v from (select k, b, case when v6 & 1 = 1 then xor(v6 >> 1, 3988292384::uinteger) else v6 >> 1 end as v7 from (
        select k, b, case when v5 & 1 = 1 then xor(v5 >> 1, 3988292384::uinteger) else v5 >> 1 end as v6 from (select k, b, case when v4 & 1 = 1 then xor(v4 >> 1, 3988292384::uinteger) else v4 >> 1 end as v5 from (
        select k, b, case when v3 & 1 = 1 then xor(v3 >> 1, 3988292384::uinteger) else v3 >> 1 end as v4 from (select k, b, case when v2 & 1 = 1 then xor(v2 >> 1, 3988292384::uinteger) else v2 >> 1 end as v3 from (
        select k, b, case when v1 & 1 = 1 then xor(v1 >> 1, 3988292384::uinteger) else v1 >> 1 end as v2 from (select k, b, case when v & 1 = 1 then xor(v >> 1, 3988292384::uinteger) else v >> 1 end as v1 from reg
        where k < (select max(len) from words)))))))))
),
bits as (select f, len, unnest(range(len)) as j, x from words),
sums as (select bits.f, bits.len, bit_xor(reg.v) as v from bits join reg on reg.k = bits.len - bits.j and reg.b = ('0x' || substr(bits.x, 2 * bits.j::int + 1, 2))::int group by all),
buckets as (select sums.f, xor(xor(sums.v, reg.v), 4294967295::uinteger) % 10000 as bucket from sums join reg on reg.k = sums.len and reg.b = 256),
per_b as (select side, r, bucket, sum(n) as n from per join buckets using (f) group by all),
c as (select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from per_b group by bucket),
tot as (select sum(s) as s_all, sum(t) as t_all from c),
g as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from c, tot),
wt as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from per_b join g using (bucket) where side = 'd' group by r),
sc as (select w.doc_id, len(w.ws) as n, coalesce(wt.n_features, 0) as n_features, coalesce(wt.weight, 0) as weight,
    coalesce(wt.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::ubigint + 0.5::double) / 4294967296)))::bigint as score from w left join wt using (r) where w.side = 'd'),
rk as (select *, case when n >= 20 then row_number() over (partition by n >= 20 order by score desc, doc_id) end as place, count(*) filter (n >= 20) over () as total from sc)
select doc_id, n_features, weight, score, case when place <= 5 * total // 100 then place end as rank from rk
"""
