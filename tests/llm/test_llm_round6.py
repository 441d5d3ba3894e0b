"""What stays in memory: words go to the tokenizer in small calls, the list of sources starts no Python workers."""

import random

import pyarrow as pa
import pytest

from wavemill.llm import mixing, packing


class Recorded:
    """A tokenizer that notes how many words each call gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.calls.append(sum(len(t.split()) for t in texts))
        return self.tokenizer.encode_batch_fast(texts, **how)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


@pytest.mark.parametrize("gather", [1, 3, 1000])
def test_words_go_to_the_tokenizer_in_small_calls(monkeypatch, gather):
    monkeypatch.setattr(packing, "CALL", 7)
    monkeypatch.setattr(packing, "GATHER", gather)
    rng = random.Random(gather)
    pool = ["".join(rng.choices("abcdeéßXYZ", k=rng.randrange(1, 9))) + rng.choice(["", "", ",", "..."]) for _ in range(300)] + [f"{rng.randrange(10**6)}日" for _ in range(40)]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(pool, k=rng.randrange(0, 60))) for _ in range(50)] + ["", None, " ", "a\x1cb"]
    enc = packing.WordEncoder(packing.tokenizer_path())
    plain, enc.tokenizer = enc.tokenizer, Recorded(enc.tokenizer)
    for part in (texts[:20], texts[20:], [], texts):
        got = enc.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
    assert len(enc.tokenizer.calls) > 20 and max(enc.tokenizer.calls) <= 7


def test_sources_start_no_python_workers(spark):
    rows = spark.createDataFrame([("b", 5), (None, 2), ("", 0), ("b", 4)], "source string, size long")
    of = mixing.source_targets(rows)
    assert [tuple(r)[:3] for r in of.collect()] == [(0, "", 0), (1, "b", 9), (2, None, 2)]
    assert of.schema.simpleString() == "struct<_src:int,source:string,source_size:bigint,target:double>"
    assert "ExistingRDD" not in of._jdf.queryExecution().toString()
    assert mixing.source_targets(rows.where("false")).collect() == []
