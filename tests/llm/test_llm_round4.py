"""Remembered words: those met most often stay, and what is forgotten changes no ids. Fingerprints of odd rows."""

import random
import re
from collections import Counter

import xxhash

from wavemill.llm import packing, simhash


def test_words_met_most_often_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 300)
    monkeypatch.setattr(packing, "KEEP", 40)
    enc = packing.WordEncoder(packing.tokenizer_path())
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghilmnoprstuéß") for _ in range(9))
    often = [f"{name()}{mark}" for mark in ("", ".", ",", "!?", "") for _ in range(4)]
    for step in range(30):  # the frequent words are met only after KEEP others
        text = " ".join([name() + rng.choice(["", ".", "́", "7"]) for _ in range(60)] + often * 3 * (step > 1) + [w.upper() for w in often])
        assert enc.encode([text, "", text.title()])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(enc.known) <= 300 + 2 * 200
    enc._keep()
    assert len(enc.known) == packing.KEEP and set(often) <= set(enc.known)
    assert enc.encode([" ".join(often)])[0].tolist() == enc.tokenizer.encode(" ".join(often), add_special_tokens=False).ids


def test_letters_shared_by_words_are_held_once():
    enc = packing.WordEncoder(packing.tokenizer_path())
    enc.encode(["house"])
    used = enc.used
    assert enc.encode(["House HOUSE hOUSE"])[0].tolist() == enc.encode(["house house house"])[0].tolist()
    assert enc.used == used


def test_simhash_query_on_odd_rows(spark, tmp_path):
    """Fingerprints by patterns over code points and all pairs of them, against the query."""
    words = [f"w{k * 7919 % 1000}" for k in range(260)]
    texts = [None, "", " ", "a", "A b", "a b c", "a\x1cb\x1dc d", "x\x85y z q", "　  x", "\x00 \x00 \x00", "İ É K", "﻿x y z", "a a a a a", "A A\x0ba a a", "\U0001f600 b c d"]
    texts += [" ".join(words[k : k + 200]) for k in range(60)]  # a chain, whose ends are far from each other
    rows = [(None if k in (1, 40) else k * 7 % 75 - 30, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    low = {65 + k: 97 + k for k in range(26)}

    def plain(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    found = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (found[i] ^ found[j]).bit_count() <= 3:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((d for (d, _), x in zip(rows, root, strict=True) if x == r and d is not None), default=None) for r in root}
    want = Counter((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, found, root, strict=True))
    assert Counter(map(tuple, simhash.op2_simhash(spark, str(tmp_path)).collect())) == want
