"""Resampling, decontamination and fill-in-middle against plain versions, and on nulls, odd texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import decontamination, fill_middle, substring_dedup, target_sampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["place", "row", "rank", "score", "weight", "n", "form", "marked", "a", "b", "h1", "prefix", "first", "last", "items", "item", "starts", "stream", "__id", "__row"]
LONG = "Over the hills " * 90_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \x00\t\n"), (5, "\x01\x02 \x022\x011 é ñ 漢字 😀a😀"), (6, LONG), (7, "<P>taken</P> <S>"),
    (8, "x" * 30_000 + " " + "y" * 70), (None, "null id: one two three four five six seven eight nine ten"), (9, "same same " * 30), (9, "same same " * 30), (10, "SAME same " * 30), (11, "a<S b<P c<M> d"), (12, "ends in a marker's start <"), (13, "Zz"),
]
TESTS = [(5, "two three four five six seven eight nine ten eleven twelve"), (40, "Null ID"), (7, None), (8, "..."), (None, "same same same"), (5, "漢字"), (41, "the hills over the hills over the hills over the hills")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in TEXTS], SCHEMA)
    return rows.select("*", *(F.lit("clash").alias(c) for c in ODD))


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame(TESTS, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("place", F.lit(1))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]).encode() for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]


def plain_resample(docs, target, percent=5, least=20, buckets=10_000):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * buckets
        for t in texts:
            for f in features_of(t):
                c[zlib.crc32(f) % buckets] += 1
        counts.append(c)
    s_all, t_all = map(sum, counts)
    gains = [math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(*counts, strict=True)]
    out = []
    for i, t in docs:
        f = features_of(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[zlib.crc32(x) % buckets] for x in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(t)) >= least))
    drawn = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0]))
    drawn = drawn[: percent * len(drawn) // 100]
    return sorted(((*x[:4], drawn.index(x) + 1 if x in drawn else None) for x in out), key=str)


def test_resample_is_the_plain_one(spark, docs, tests):
    got = target_sampling.resample(docs, tests)
    assert sorted((tuple(r) for r in got.drop("row").collect()), key=str) == plain_resample(TEXTS, [t for _, t in TESTS])
    rng = random.Random(3)
    vocabulary = ["a", "Bc", "déf", "ghi9", "q" * 47, "r" * 48, "s" * 49, "t" * 300, "u"]
    many = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for k in range(300)]
    aims = [" ".join(rng.choices(vocabulary[:4], k=30)) for _ in range(5)]
    table, aim = spark.createDataFrame(many, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in aims], "text string")
    for percent, least in ((5, 20), (37, 2), (100, 0)):
        got = target_sampling.resample(table, aim, percent, least)
        assert sorted((tuple(r) for r in got.drop("row").collect()), key=str) == plain_resample(many, aims, percent, least)


def test_resample_draws_exactly_its_share_of_equal_rows(spark, docs, tests):
    same = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.lit("so many words " * 10).alias("text"))
    ranks = [r["rank"] for r in target_sampling.resample(same, tests, percent=50).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 21)) and ranks.count(None) == 20
    assert target_sampling.resample(docs.limit(0), tests).count() == 0 and target_sampling.resample(docs, tests.limit(0)).count() == len(TEXTS)
    left = target_sampling.resampled_documents(docs, tests, percent=40)
    assert left.columns == docs.columns and 0 < left.count() < len(TEXTS)


def test_streams_are_cut_anywhere(spark):
    """Blocks and forgetting change nothing; a block of more words than allowed is one document."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 5, 50]))) for _ in range(60)]
    whole = target_sampling.Features()
    want, runs = whole.of([whole.numbers(t.encode()) for t in texts])
    assert want.tolist() == [zlib.crc32(f) % 10_000 for t in texts for f in features_of(t)] and runs.tolist() == [len(features_of(t)) for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in target_sampling.streams(table, "doc_id", block=20).collect():
        stream = np.frombuffer(bytes(r.stream), "<u2")
        assert len(stream) == r.starts[-1] and len(r.starts) == len(r.ids) + 1
        got |= {i: stream[a:b].tolist() for i, a, b in zip(r.ids, r.starts[:-1], r.starts[1:], strict=True)}
    assert [x for i in range(60) for x in got[i]] == want.tolist()


def plain_contamination(docs, tests, window):
    windows = {}
    for name, text in tests:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, items = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def rows_of(report):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in report.collect()), key=str)


def test_contamination_is_the_plain_one(docs, tests):
    want = plain_contamination(TEXTS, TESTS, 10)
    for shard, most in ((1 << 21, 1 << 24), (50, 1 << 24), (1000, 200)):
        assert rows_of(decontamination.contamination(docs, tests, 10, shard, most)) == want
    left = decontamination.drop_contaminated(docs, tests)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, n, _ in want if not n)
    assert decontamination.contamination(docs.limit(0), tests).count() == 0
    assert rows_of(decontamination.contamination(docs, tests.limit(0))) == sorted(((i, n, 0, []) for i, n, _, _ in want), key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 10])
def test_contamination_of_few_words(spark, window):
    """A small vocabulary, so that windows overlap, repeat, share their starts and stand in many tests."""
    rng = random.Random(window)
    texts = [(k, " ".join(rng.choices("abc", k=rng.choice([0, 1, 2, 9, 10, 11, 80])))) for k in range(120)]
    items = [(k % 17, " ".join(rng.choices("abcd", k=rng.choice([0, 1, 2, 3, 4, 9, 10, 14])))) for k in range(25)]
    table, tests = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for shard, most in ((1 << 21, 1 << 24), (30, 1 << 24), (300, 400)):
        assert rows_of(decontamination.contamination(table, tests, window, shard, most)) == plain_contamination(texts, items, window)


def test_longest_matches(spark):
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choices("abcd", k=60))) for k in range(30)]
    items = [(k, " ".join(rng.choices("abcd", k=12))) for k in range(8)]
    table, tests = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(int(r.item_id), r.start): r for r in decontamination.longest_matches(table, tests, window=4, shard=500).collect()}
    for name, text in items:
        w = words_of(text)
        for start in range(len(w)):
            found = {}
            for i, other in texts:
                o = words_of(other)
                for at in range(len(o)):
                    n = 0
                    while start + n < len(w) and at + n < len(o) and w[start + n] == o[at + n]:
                        n += 1
                    found.setdefault(n, set()).add((i, at))
            r = got.get((name, start))
            assert (r is None) == (max(found) < 4)
            assert r is None or (r.length == max(found) and r.places == len(found[r.length]) and (r.doc_id, r.word) in found[r.length])


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        tokens = np.r_[rng.integers(0, 4, rng.integers(0, 60)), 0].astype(np.int32)
        order = decontamination.suffix_array(tokens, 64).tolist()
        suffix = lambda k: tokens[k : k + int(np.argmax(tokens[k:] == 0))].tolist()  # noqa: B023, E731
        assert sorted(order) == np.flatnonzero(tokens).tolist() and [suffix(k) for k in order] == sorted(suffix(k) for k in order)


def plain_middle(i, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (i, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle_is_the_plain_one(spark, docs):
    rng = random.Random(6)
    odd = ["\x01", "\x02", "\x021", "<", "<S", "<P", "S>", "word", " ", "\n", "1", "2", "é", "😀", "$0", "\\", "<M>"]
    texts = [*TEXTS, *((100 + k, "".join(rng.choices(odd, k=rng.choice([0, 1, 2, 3, 8, 40])))) for k in range(400))]
    table = docs.unionByName(spark.createDataFrame(texts[len(TEXTS) :], "doc_id long, text string"), allowMissingColumns=True)
    got = fill_middle.fill_in_middle(table).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted((plain_middle(i, t) for i, t in texts), key=str)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in texts) and {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_no_python_in_fill_in_middle(docs):
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_passages_are_cut_from_their_own_text(spark):
    """Another text of the same id, and a null one, keep all their words; spans that overlap are cut once."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    shared, other = words(120), words(200)
    rows = [(1, f"{words(40)}\n{shared}\n{words(40)}"), (2, f"{words(60)}\n{shared}"), (2, other), (None, None), (None, f"{shared}\n{words(30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    found = substring_dedup.repeated_passages(docs)
    left = substring_dedup.remove_passages(docs, found)
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert other in texts and None in texts and sum(shared in (t or "") for t in texts) == 1 and len(texts) == 5
    spans = spark.createDataFrame([("aéb😀cdefgh", [(1, 3), (2, 4), (6, 7)])], "t string, s array<struct<start:int,end:int>>")
    assert spans.select(substring_dedup.without(F.col("t"), F.col("s")).alias("x")).first().x == "acdfgh"
