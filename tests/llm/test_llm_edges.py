"""Each operator on nulls, empty and long texts, ties, repeated rows, an empty table, and clashing extra columns."""

import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from wavemill.llm import exact_dedup, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 9000
ROWS = [
    (1, "Alpha beta gamma", "en", "a", 1), (2, "alpha BETA gamma", "en", None, 1), (3, None, None, "b", None), (4, "", "de", "b", 0), (5, " \n\t ", "xx", "", 4),
    (6, LONG, "en", "a", 1), (7, LONG + "end", "en", "a", 1), (8, "x" * 50_000, "fr", "a", 1), (None, "null id text", "en", "a", 1), (9, "tie one two", "en", "c", 1), (10, "tie two one", "en", "c", 1),
    (11, "same row", "en", "c", 1), (11, "same row", "en", "c", 1), (12, "mail a@b.co or 10.0.0.1 é", "es", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    odd = ["size", "copies", "target", "h", "shard", "fp", "node", "bucket", "words", "_t", "key", "s", "e", "k", "n", "digest", "keep_id", "_good", "__k"]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *(F.lit("clash").alias(c) for c in odd))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 1, 0), (11, 1, 0), (12, 1, 0), (5, 0, 0), (8, 0, 1), (9, 1, None), (10, None, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert (False, 1, 2, 2, False) in got and (False, 2, 2, 2, True) in got and (False, 3, 4, 2, False) in got and (True, None, None, 1, True) in got
    assert got.count((False, 11, 11, 2, True)) == 2 and len(got) == len(ROWS)
    assert exact_dedup.exact_dedup(none).count() == 0
    low = {(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs, keep="min").collect()}
    assert (1, True) in low and (2, False) in low
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def test_merge_rounds_agree(docs):
    rows = exact_dedup.digests(docs.repartition(7, "source"))
    a, b = ({(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.merge_runs(rows, f, n).collect()} for f, n in ((2, 4), (64, 0)))
    assert a == b


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS) and all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4 for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].size == 8 and by_id[3].text_crc32 == 0 and by_id[3].shard == by_id[4].shard and by_id[12].text_crc32 == zlib.crc32("mail a@b.co or 10.0.0.1 é".encode())
    assert sharding.shard_documents(none).count() == 0


def test_simhash(docs, none):
    by_id = {r.doc_id: r for r in simhash.simhash_dedup(docs).collect()}
    assert by_id[3].fingerprint == by_id[5].fingerprint == "0" * 16 and by_id[5].component_id == 3
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].component_id == 1 and by_id[6].component_id == by_id[7].component_id == 6
    assert simhash.simhash_dedup(docs).count() == len(ROWS) and simhash.simhash_dedup(none).count() == 0
    left = simhash.drop_near_copies(docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and {3, 4, 5, 6, 8, None} <= set(ids) and 2 not in ids and ids.count(11) == 2
    assert simhash.drop_near_copies(none).count() == 0


def test_substring_dedup(spark, docs, none):
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {6, 7} and all(LONG[r.start : r.end].split() for r in got) and not any(r.removed for r in got if r.doc_id == 6 and r.start == 0)
    assert substring_dedup.repeated_passages(none).count() == 0
    cleaned = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs))
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS) and len(cleaned.where("doc_id = 7").first().text) < 0.5 * len(LONG)


def test_personal_data(spark, docs, none):
    model = pii.fit(spark, n=1200)
    rows = {r.doc_id: r for r in pii.find_personal_data(docs, model).selectExpr("doc_id", pii.joined("spans_base") + " b").collect()}
    assert rows[12].b == "email:5:11,ip:15:23" and rows[3].b == rows[4].b == rows[8].b == ""
    assert pii.find_personal_data(docs, model).count() == len(ROWS) and pii.find_personal_data(none, model).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert red[12] == "mail <email> or <ip> é" and red[3] == "" and red[6] == LONG


def test_personal_data_of_long_texts(spark):
    """A megabyte of addresses, of digits, and of candidates without end takes seconds and loses nothing."""
    texts = ["user77@mail.example.com " * 42_000, "10.20.30.40 " * 40_000, "9" * 1_000_000, "659-555-3949 " * 20_000, "name at host dot com " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    model = pii.fit(spark, n=1200)
    began = time.time()
    got = {r.doc_id: (r.b, r.a, r.last) for r in pii.find_personal_data(docs, model).selectExpr("doc_id", "size(spans_base) b", "size(spans_all) a", "try_element_at(spans_all, -1).e last").collect() if r.a}
    assert got[0][:2] == (42_000, 42_000) and got[1][:2] == (40_000, 40_000) and got[3][1] == 20_000 and got[0][2] == 24 * 42_000 - 1
    assert time.time() - began < 60
    assert {r.doc_id: len(r.text) for r in pii.redact(docs.where("doc_id = 0"), model).collect()} == {0: 8 * 42_000}


def test_quality_classifier(docs, none, labels):
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and {r.log_weight for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert [sum(r.kept for r in quality_classifier.classify(docs, labels, k=k).collect()) for k in (3, 7, 8, 9, 99)] == [3, 7, 8, 9, len(ROWS)]
    assert not any(r.kept for r in quality_classifier.classify(docs, labels, k=0).collect())
    assert all(r.kept for r in quality_classifier.classify(docs, labels.limit(0)).collect())
    assert quality_classifier.classify(none, labels).count() == 0 and quality_classifier.drop_low_quality(none, labels).count() == 0
    assert quality_classifier.drop_low_quality(docs, labels).columns == docs.columns


def test_quality_rules(docs, none):
    by_id = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert by_id[3].n_words == 0 and by_id[3].base_failed and not by_id[3].kept and by_id[8].word_chars == 50_000 and by_id[6].n_repeat_words == 27_000
    assert quality_rules.judge(docs).count() == len(ROWS) and quality_rules.judge(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    ids = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length <= packing.TOKENS
        ids.setdefault(r.doc_id, 0)
        ids[r.doc_id] += r.length
    assert ids[3] == ids[4] == ids[5] == 1 and set(ids) == {r[0] for r in ROWS} and packing.pack_documents(none).count() == 0
    by_seq = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_seq.get(r.sequence_id, 0)
        by_seq[r.sequence_id] = r.offset + r.length


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows) and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)


def test_digest_is_of_normalised_text(docs):
    want = hashlib.sha256("alpha beta gamma".encode()).hexdigest()
    assert {r.text_sha256 for r in exact_dedup.exact_dedup(docs).where("doc_id in (1, 2)").collect()} == {want}
