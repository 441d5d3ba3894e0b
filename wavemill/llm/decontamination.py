"""Benchmark decontamination by suffix arrays of the training texts.

The training texts are cut into shards of some million words where they lie. Each shard sorts its suffixes, and every suffix of the tests is
searched in that array, word after word, by binary searches for the ends of the stretch of suffixes that still agree. How far
the search comes is the longest verbatim match, the stretch holds its locations. A test's windows (ten words in a row, a shorter test whole) are
found where the stretch at their length isn't empty. Documents with such places can be removed.

Only places that can be inside a window enter a shard's array: words of the tests that follow each other as they do in some test,
as many in a row as the shortest window has. The tests are a list given to every task, a bounded block of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, frugal, sized, table
from .lettered import lettered

WINDOW = 10
#: Words of a shard; a longer document is a shard of its own.
SHARD = 1 << 21
#: Bytes of test texts that tasks get at a time; more tests go in several blocks, one after the other.
MOST_TESTS = 16 << 20
#: Links of documents and tests that are listed in one go.
LINKS = 1 << 20


class Tests:
    """Tests as one array of word numbers from 1, a zero behind each: their windows, words and pairs of words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.number = window, {}
        names, tokens = [], []
        for name, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for words in lettered(text) for w in words]
            if own:
                names.append(name)
                tokens.append(np.array([*own, 0], dtype=np.int32))
        self.tokens = np.concatenate([*tokens, np.zeros(1, np.int32)])
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.names = np.array(names, dtype=object)
        # Of every suffix its test, its place in the array and in the test, how many words are left, and its window's length, 0 if none starts there.
        self.item = np.repeat(np.arange(len(names)), sizes - 1)
        self.at = np.flatnonzero(self.tokens)
        first = (np.cumsum(sizes) - sizes)[self.item]
        length = (sizes - 1)[self.item]
        self.start, self.left = self.at - first, first + length - self.at
        self.width = np.where(self.left >= window, window, np.where((length < window) & (self.at == first), length, 0))
        self.least = int(self.width[self.width > 0].min()) if len(self.at) else 0
        self.longest = int(length.max()) if len(self.at) else 0
        size = 1 << max(16, (16 * len(self.tokens)).bit_length())
        self.follows = np.zeros(size, dtype=bool)
        a, b = self.tokens[:-1], self.tokens[1:]
        self.follows[self._pair(a, b)[(a > 0) & (b > 0)]] = True

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A place in ``follows``; pairs that share one only let more places through."""
        return (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA77) & (len(self.follows) - 1)

    def numbers(self, text: bytes) -> np.ndarray:
        """A text's words by their numbers in the tests, 0 for a word of none."""
        get = self.number.get
        return np.concatenate([np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in lettered(text)])

    def possible(self, tokens: np.ndarray) -> np.ndarray:
        """Places of runs of at least the shortest window's words that follow each other as in the tests."""
        inside = tokens > 0
        near = np.flatnonzero(inside[:-1] & inside[1:])
        near = near[self.follows[self._pair(tokens[near], tokens[near + 1])]]
        link = np.zeros(len(tokens), dtype=bool)
        link[near] = True  # this word and the next
        starts = np.flatnonzero(inside & ~np.r_[False, link[:-1]])
        ends = np.flatnonzero(inside & ~link) + 1
        kept = ends - starts >= max(self.least, 1)
        mark = np.zeros(len(tokens) + 1, dtype=np.int8)
        mark[starts[kept]] = 1
        mark[ends[kept]] -= 1
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the nonzero tokens in order of their suffixes' first ``depth`` words, by doubling of ranks."""
    at = np.flatnonzero(tokens)
    rank, done = tokens.astype(np.int64), 1
    order = at[np.argsort(rank[at], kind="stable")]
    while done < depth and len(at):
        later = np.zeros_like(rank)
        later[:-done] = rank[done:]
        key = rank[at] * (int(rank.max()) + 1) + later[at]
        by = np.argsort(key, kind="stable")
        order, key = at[by], key[by]
        new = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        rank = np.zeros_like(rank)
        rank[order] = new
        done *= 2
        if new[-1] == len(at):
            break
    return order


def _bound(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
    """First place in order[low:high] whose word at ``depth`` isn't smaller than wanted, for many searches at a time."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        less = open_ & (tokens[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(tokens) - 1)] < want)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def search(tokens: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """Of every test suffix its longest match in words and the ends of that match's stretch, and the ends of its window's stretch (0, 0: not found).

    ``tokens`` end with a zero.
    """
    n = len(tests.at)
    longest, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    found_low, found_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, depth = np.arange(n), 0
    while len(live) and len(order):
        want = tests.tokens[tests.at[live] + depth]
        a = _bound(tokens, order, low[live], high[live], depth, want)
        b = _bound(tokens, order, a, high[live], depth, want + 1)
        on = a < b
        live, depth = live[on], depth + 1
        low[live], high[live], longest[live] = a[on], b[on], depth
        here = live[tests.width[live] == depth]
        found_low[here], found_high[here] = low[here], high[here]
        live = live[tests.left[live] > depth]
    return longest, low, high, found_low, found_high


class Shard:
    """The suffixes of some documents that can match a test."""

    def __init__(self, docs: list[np.ndarray], tests: Tests):
        self.tests = tests
        self.sizes = np.array([len(x) for x in docs], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1  # a zero ends each document
        tokens = np.zeros(int((self.sizes + 1).sum()) + 1, dtype=np.int32)
        for x, s in zip(docs, self.starts.tolist(), strict=True):
            tokens[s : s + len(x)] = x
        places = tests.possible(tokens)
        new = np.r_[True, np.diff(places) > 1] if len(places) else np.zeros(0, bool)
        # The kept runs, a zero before each and one behind the last.
        self.place = np.full(len(places) + int(new.sum()) + 1, -1, dtype=np.int64)
        self.place[np.arange(len(places)) + np.cumsum(new)] = places
        self.tokens = np.where(self.place >= 0, tokens[self.place], 0)
        self.order = suffix_array(self.tokens, tests.longest)
        self.longest, self.low, self.high, self.found_low, self.found_high = search(self.tokens, self.order, tests)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes with a match of the shortest window's words and more, and one document and word where the longest one is."""
        own = np.flatnonzero((self.longest >= max(self.tests.least, 1)) & (self.low < self.high))
        places = self.place[self.order[self.low[own]]]
        doc = self.document(places)
        return own, doc, places - self.starts[doc]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of hit words (document, first word, word after the last), and the links of documents and classes of equal windows: document, class; class, test."""
        own = np.flatnonzero(self.found_low < self.found_high)
        # Equal windows share a stretch: one class, so that a window of many tests is located once.
        stretch = np.stack([self.found_low[own], self.found_high[own], self.tests.width[own]], axis=1)
        kinds, cls = np.unique(stretch, axis=0, return_inverse=True) if len(own) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        count = kinds[:, 1] - kinds[:, 0]
        which = np.repeat(np.arange(len(kinds)), count)
        at = self.order[np.repeat(kinds[:, 0] - np.cumsum(count) + count, count) + np.arange(len(which))]
        change = np.zeros(len(self.place) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + kinds[which, 2], -1)
        hit = np.r_[False, np.cumsum(change[:-1]) > 0, False]
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        first, last = self.place[edge[::2]], self.place[edge[1::2] - 1] + 1
        doc = self.document(first)
        # Kept runs are parted by other words or by an end, so no span goes over either.
        links = np.unique(self.document(self.place[at]) * max(len(kinds), 1) + which)
        tests = np.unique(np.stack([cls.ravel(), self.tests.item[own]], axis=1), axis=0) if len(own) else np.zeros((0, 2), np.int64)
        return doc, first - self.starts[doc], last - self.starts[doc], links // max(len(kinds), 1), links % max(len(kinds), 1), tests[:, 0], tests[:, 1]


#: Of a document: its place in the table, id, row hash, number of words, spans of hit words, and the tests found in it.
REPORT = "place long, doc_id long, row long, n_words long, first array<int>, last array<int>, items array<string>"


def _lists(keys: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def reported(shard: Shard, columns: list[list]) -> Iterator[pa.RecordBatch]:
    doc, first, last, linked, cls, of, item = shard.hits()
    per = np.bincount(of, minlength=int(cls.max()) + 1 if len(cls) else 0)
    begin = np.cumsum(per) - per
    load = np.zeros(len(shard.sizes), dtype=np.int64)
    np.add.at(load, linked, per[cls] if len(cls) else 0)
    group, a = np.cumsum(load) // LINKS, 0
    while a < len(shard.sizes):  # documents by the number of their tests, so that a batch stays small
        b = int(np.searchsorted(group, group[a], side="right"))
        spans, own = slice(*np.searchsorted(doc, [a, b])), slice(*np.searchsorted(linked, [a, b]))
        k = per[cls[own]] if len(cls) else np.zeros(0, np.int64)
        tests = item[np.repeat(begin[cls[own]] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
        pairs = np.unique(np.stack([np.repeat(linked[own], k), tests], axis=1), axis=0) if len(tests) else np.zeros((0, 2), np.int64)
        part = [pa.array(c[a:b], pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(
            [*part, pa.array(shard.sizes[a:b]), _lists(doc[spans] - a, first[spans], b - a, pa.int32()), _lists(doc[spans] - a, last[spans], b - a, pa.int32()), _lists(pairs[:, 0] - a, shard.tests.names[pairs[:, 1]], b - a, pa.string())],
            names=[x.split()[0] for x in REPORT.split(", ")],
        )
        a = b


#: Of a test suffix: its test, first word and longest match in words, in how many places that is, and one of them.
MATCH = "item_id string, start long, length long, places long, doc_id long, word long"


def matched(shard: Shard, columns: list[list]) -> Iterator[pa.RecordBatch]:
    own, doc, word = shard.matches()
    tests, ids = shard.tests, [columns[1][d] for d in doc.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(tests.names[tests.item[own]], pa.string()), pa.array(tests.start[own]), pa.array(shard.longest[own]), pa.array((shard.high - shard.low)[own]), pa.array(ids, pa.int64()), pa.array(word)], names=[x.split()[0] for x in MATCH.split(", ")])


def over_shards(rows: DataFrame, items: list[tuple[str, bytes]], window: int, shard: int, give, schema: str) -> DataFrame:
    """``give`` over every shard of ``rows`` (place, doc_id, row, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(items, window)
        held, words, columns = [], 0, [[], [], []]
        for batch in batches:
            own = [batch.column(k).to_pylist() for k in range(3)]
            for k, text in enumerate(batch.column(3)):
                held.append(tests.numbers(text.as_py() or b""))
                words += len(held[-1]) + 1
                for c, values in zip(columns, own, strict=True):
                    c.append(values[k])
                if words >= shard:
                    yield from give(Shard(held, tests), columns)
                    held, words, columns = [], 0, [[], [], []]
        if held:
            yield from give(Shard(held, tests), columns)

    return rows.mapInArrow(lambda batches: frugal(work(batches)), schema)


def named_tests(benchmark: DataFrame, most: int = MOST_TESTS) -> tuple[DataFrame, int]:
    """The tests (item, text), equal ones once, and in how many blocks of about ``most`` bytes they go to the tasks."""
    rows = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text") + F.length("item") + 64)).first()[0] or 0
    blocks = 1 + int(size // most)
    return (cut(rows, "tests") if blocks > 1 else rows), blocks


def block_of(tests: DataFrame, k: int, blocks: int) -> list[tuple[str, bytes]]:
    """The tests of a block, told apart by a hash of their text."""
    return [(r["item"], bytes(r["text"])) for r in tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item", "text").collect()]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, most_tests: int = MOST_TESTS) -> DataFrame:
    """REPORT's columns of every row of ``docs``; spans are in order, and may meet or overlap when the tests take several blocks."""
    tests, blocks = named_tests(benchmark, most_tests)
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    if blocks == 1:
        return over_shards(rows, block_of(tests, 0, 1), window, shard, reported, REPORT)
    rows = cut(rows, "placed")  # places that stay from one pass to the next
    found = [cut(over_shards(rows, block_of(tests, k, blocks), window, shard, reported, REPORT), "reported") for k in range(blocks)]
    every = reduce(DataFrame.unionByName, found)
    both = every.groupBy("place").agg(
        F.first("doc_id").alias("doc_id"), F.first("row").alias("row"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("first", "last")))).alias("_s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return both.select("place", "doc_id", "row", "n_words", F.col("_s.first").alias("first"), F.col("_s.last").alias("last"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, most_tests: int = MOST_TESTS) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_hit, spans (first word, word after the last), items of every row of ``docs``.

    ``benchmark`` (item_id, text): tests of one id count as one, a null id as an empty name; tests without words have no window. Null and empty texts have no
    words and no hits. Repeated rows come back repeated. Whole texts are searched, of any length. items are distinct and sorted as strings. Other
    columns are not read; empty input gives no rows, and without tests nothing is hit.
    """
    rows = report(docs, benchmark, window, shard, most_tests)
    spans = F.arrays_zip("first", "last").alias("spans")
    # Of spans in order, what each adds beyond the ends before it.
    hit = F.expr("aggregate(arrays_zip(first, last), named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.last - greatest(x.first, a.e)), 'e', greatest(a.e, x.last)), a -> a.n)")
    return rows.select("doc_id", "row", "n_words", hit.alias("n_hit"), spans, F.array_sort(F.array_distinct("items")).alias("items"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, most_tests: int = MOST_TESTS) -> DataFrame:
    """item_id, start, length, places, doc_id, word: of every test suffix (by its first word) the longest verbatim match, the number of its places and one of them.

    Matches shorter than the shortest window of the tests aren't listed. Nulls and repeated rows as in ``contamination``.
    """
    rows = docs.select(F.lit(0).cast("long").alias("place"), F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("row"), F.col("text").cast("binary").alias("text"))
    tests, blocks = named_tests(benchmark, most_tests)
    found = [cut(over_shards(rows, block_of(tests, k, blocks), window, shard, matched, MATCH), "matches") for k in range(blocks)]
    each = reduce(DataFrame.unionByName, found).groupBy("item_id", "start", "length").agg(F.sum("places").alias("places"), F.min(F.struct("doc_id", "word")).alias("_p"))
    best = each.groupBy("item_id", "start").agg(F.max(F.struct("length", "places", "_p")).alias("b"))
    return best.select("item_id", "start", "b.length", "b.places", "b._p.doc_id", "b._p.word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, columns unchanged; nulls and repeated rows as in ``contamination``."""
    i, h = fresh(docs, "__id", "__row")
    gone = cut(contamination(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("row").alias(h)).distinct(), "contaminated")
    return docs.join(sized(gone), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark texts; nulls, short texts and repeated rows as in ``contamination``."""
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
wb as (select item_id, least(10, len(ws)) as w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i, ws from b where len(ws) > 0),
win as (select distinct item_id, w, array_to_string(ws[i:i + w - 1], ' ') as g from wb),
grams as (select distinct w, g from win),
dw as (select r, g.w, unnest(range(1, len(ws) - g.w + 2)) as i, ws from d, (select distinct w from win) g where len(ws) >= g.w),
occ as materialized (select r, dw.w, i, array_to_string(ws[i:i + dw.w - 1], ' ') as g from dw),
hit as materialized (select r, w, i, g from occ semi join grams using (w, g)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + w)) as p from hit) group by r),
it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct hit.r, cast(item_id as varchar) as item from hit join win using (w, g)) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join it using (r)
"""
