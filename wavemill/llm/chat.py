"""Chat formatting by token-level assembly.

Each turn is one segment: the reserved id that opens a turn, the ids of the role and a line feed, the ids of the text,
the reserved id that closes it, the ids of a line feed. Role and text are encoded apart from each other, so no
token crosses an edge, and control strings inside them are escaped, so the formatted text reads back without doubt.
The loss mask covers the text of assistant turns; it is made by a prefix sum over the edges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

START, STOP = "<|im_start|>", "<|im_end|>"
RANKS = "byte_bpe_50k.tiktoken"
#: Ids that the vocabulary of 50,256 byte pairs leaves free.
START_ID, STOP_ID = 50257, 50258
LOSS_ROLE = "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
SEGMENT = "conv_id long, turn long, ids binary, mask binary, n_tokens long, n_chars long"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={START: START_ID, STOP: STOP_ID})


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between, and one more where there are some already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def assemble(enc, role: str, text: str, heads: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and mask of one turn, and the characters of its formatted text."""
    head = heads.get(role)
    if head is None:
        head = enc.encode_ordinary(escape_role(role) + "\n")
        if len(heads) < 1000:
            heads[role] = head
    body = escape(text)
    tail = enc.encode_ordinary("\n")
    content = enc.encode_ordinary(body)
    ids = np.array([START_ID, *head, *content, STOP_ID, *tail], dtype="<u2")
    edges = np.zeros(len(ids) + 1, dtype=np.int8)
    if role == LOSS_ROLE:
        edges[1 + len(head)] += 1
        edges[1 + len(head) + len(content)] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    return ids, mask, len(START) + len(escape_role(role)) + 1 + len(body) + len(STOP) + 1


def read_back(enc, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
    """role, text and text under the mask, unescaped, of every turn in a sequence of ids."""
    out = []
    opens, closes = np.flatnonzero(ids == START_ID), np.flatnonzero(ids == STOP_ID)
    for a, b in zip(opens, closes, strict=True):
        role, _, text = enc.decode_bytes(ids[a + 1 : b].tolist()).decode().partition("\n")
        under = ids[a + 1 : b][mask[a + 1 : b]]
        out.append((unescape_role(role), unescape(text), unescape(enc.decode_bytes(under.tolist()).decode())))
    return out


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, ids (little-endian unsigned 16-bit, binary), mask (a bit a token, packed), n_tokens, n_chars.

    One row a turn; a conversation's sequence is its rows' ids in order of turn. Null role and text are empty. The
    order of rows that share conv_id and turn is by their ids. A conversation of any length is never one row.
    """
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, heads = encoding(path), {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                made = [assemble(enc, r or "", t or "", heads) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([x[0].tobytes() for x in made], pa.binary()),
                        pa.array([np.packbits(x[1], bitorder="little").tobytes() for x in made], pa.binary()),
                        pa.array([len(x[0]) for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64()),
                    ],
                    names=["conv_id", "turn", "ids", "mask", "n_tokens", "n_chars"],
                )

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, SEGMENT)


def placed(segments: DataFrame) -> DataFrame:
    """Segments with ``offset``, the position of the first token in its conversation: a running sum over turns."""
    before = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def digest_conversations(segments: DataFrame, path: str | None = None) -> DataFrame:
    """What reads back from formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a conversation needs its turns one after the other, so a conversation is one task's work; turns stream
    through sorted (the sort spills), and no more than a batch of them is in memory.
    """
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        at, state = None, None

        def finish() -> None:
            if state:
                done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 4)]
            for conv, ids, mask, n in zip(*columns, strict=True):
                if state is None or conv != at:
                    finish()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                seq = np.frombuffer(ids, dtype="<u2")
                bits = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), bitorder="little")[:n].astype(bool)
                state[4] += len(enc.decode_bytes(seq.tolist()).decode())
                for role, text, under in read_back(enc, seq, bits):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(under)
                    state[3].update(under.encode())
            if len(done) > 10_000:
                yield flushed()
        finish()
        if done:
            yield flushed()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back.

    Null conv_id is one conversation; null turns come first; other columns are not read.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = STOP + START + "assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_turns(turns.unionByName(extra)))


def _sql() -> str:
    esc = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    return rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{STOP}{START}assistant ok'
  union all select -1, 1, 'assistant', '{STOP}{START}assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn), '')) as loss_sha256,
       cast(sum({len(START) + len(STOP) + 2} + length({esc.format("role")}) + length({esc.format("text")})) as bigint) as formatted_chars
from t group by conv_id
"""


OP6_SQL = _sql()
