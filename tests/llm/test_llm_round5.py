"""Near copies: exact similarities of many sets at once, and groups of texts that are alike without being copies. Ids of many texts at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wavemill.llm import packing, simhash


@pytest.mark.parametrize("few", [2, 5, 16])
def test_similar_sets_match_brute_force(monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "SLAB", 7)
    rng = random.Random(few)
    for n, split in ((1, 0), (2, 0), (2, 1), (60, 0), (60, 25), (60, 59)):
        core = [rng.getrandbits(64) for _ in range(40)]
        plain = [set(rng.sample(core, rng.choice([5, 34, 38, 40]))) | {rng.getrandbits(64) for _ in range(rng.randrange(1, 6))} for _ in range(n)]
        sets = [np.array(sorted(x), dtype=np.uint64) for x in plain]
        x, y = simhash.set_links(sets, split)
        want = {(a, b) for b in range(n) for a in range(b) if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b]) and (not split or a < split <= b)}
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want) and (n < 60 or split == 59 or want)


@pytest.mark.parametrize("chunk", [64, 1024])
def test_alike_texts_make_no_rows_by_pairs(spark, monkeypatch, chunk):
    """All pairs of 300 texts pass the filter and few are near: no table has a row for each pair."""
    rng = random.Random(5)
    core = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    rows = [core + [f"x{k}y{j}" for j in range(20)] for k in range(300)]  # 100 of 140 shingles in common: 0.71
    rows += [rows[k] + ["end"] for k in range(0, 300, 3)]
    rng.shuffle(rows)
    sets = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    first: dict[str, int] = {}
    want = {k for k, r in enumerate(rows) if first.setdefault(r[104], k) == k}
    assert max(len(sets[0] & s) / len(sets[0] | s) for k, s in enumerate(sets) if rows[k][104] != rows[0][104]) < 0.8
    counts, cut = {}, simhash.cut

    def counted(df, name):
        out = cut(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs, chunk).collect()} == want
    assert counts["signatures"] == 400 and max(counts.values()) <= 12 * 400 * -(-400 // chunk)


def test_words_are_looked_up_once_a_batch():
    """Many texts at once, with all white space, nulls and control characters: the tokenizer's ids, one look-up a different word."""
    enc = packing.WordEncoder(packing.tokenizer_path())
    space = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(f"a{chr(c)}b".split()) == 2 and not 0x1C <= c <= 0x1F]
    texts = [f" one{c}Two,{c}{c}one " for c in space] + ["", " ", "\n\t", "one\x1ctwo one", "Two, été 日本 x\x00y ​", "\x1f"] + ["one two"] * 50
    looked = []

    class Counted(packing._Numbers):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    enc.known = Counted()
    got = enc.encode(pa.array([*texts, None]))
    assert [x.tolist() for x in got] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert 4 < len(looked) == len(set(looked))
    assert enc.encode(["12 日本語", " ... x"])[0].tolist() == enc.tokenizer.encode("12 日本語", add_special_tokens=False).ids
