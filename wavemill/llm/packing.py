"""Packing documents into sequences by vector bin packing with the dot-product heuristic.

The first LEAD tokens of a document are its prompt: they are context and bear no loss, all later ones do. A piece of a
document is a vector of tokens, segments (1) and loss-bearing tokens, and a sequence has a limit on each. An open
sequence takes the piece whose vector has the largest dot product with the room that is left, among those that fit;
when none fits, the piece of which most can be placed is cut there. A piece too long for any sequence is cut as soon as
one is opened. A sequence that nothing can fill is trimmed to a power of two, which needs no padding, and so are the
last ones of a task. Every task packs what it reads, in that order: no shuffle, and a lost task repeats itself exactly.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, small_batches, table

#: Tokens, segments and loss-bearing tokens that a sequence holds at most: a full one has 64 tokens of prompts or more.
TOKENS, SEGMENTS, LOSS = 2048, 32, 1984
#: Tokens at a document's start that bear no loss.
LEAD = 64
#: Texts that are encoded together: bounds memory, not results.
TEXTS = 1024
#: Pieces that are packed together: bounds memory, not results.
POOL = 2048
#: Id after each document.
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words an encoder remembers before it forgets all but those it met most often.
REMEMBER, KEEP = 400_000, 150_000
#: Words that go to the tokenizer in one call: it holds some hundred bytes a word meanwhile. Bounds memory, not results.
CALL = 4_000
#: Texts whose ids are put together at once: bounds memory, not results.
GATHER = 128
#: Words whose ids are those of their lower-cased letters and then those of the marks: Latin letters that normalising leaves as they are, and ASCII marks.
LATIN = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)"
#: The letters and the marks of each of many lines; both are empty for other words.
LINES = re.compile(f"^{LATIN}$|^.*$", re.MULTILINE)
#: Control characters that Arrow, but not the tokenizer, takes for white space.
ODD = "[\x1c-\x1f]"
#: Runs of marks remembered.
MARKS = 10_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers words in order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class WordEncoder:
    """Ids of whole texts, by remembering each word's ids.

    Holds for tokenizers that drop white space, never join across it or between letters and other characters, and
    lower-case character by character. Texts with control characters that Arrow, but not the tokenizer, takes for
    white space are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.is_end[ends] = True
        self.marks: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.learnt = _Numbers(), 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 14, dtype=kind) for kind in (np.int64, np.int64, np.int32))

    def learn(self) -> None:
        """Find the ids of the words numbered since the last time.

        The ids of a word of Latin letters are those of its lower-cased letters, with those of the marks after them;
        anything else goes to the tokenizer as it is. Letters met only inside other words are numbered too. Words of the
        same letters share their ids.
        """
        words = list(islice(reversed(self.known), len(self.known) - self.learnt))[::-1]
        if words:
            self._learn(words)
            del words
            give_back()

    def _learn(self, words: list[str]) -> None:
        stems, marks = zip(*LINES.findall("\n".join(words)), strict=True)
        stems = "\n".join(stems).lower().split("\n")
        letters = list(dict.fromkeys(stems))
        # Where the ids of letters lie; letters that aren't known yet have none.
        number = np.fromiter(map(self.known.get, letters, repeat(self.learnt)), dtype=np.int64, count=len(letters))
        some = np.fromiter(map(bool, letters), dtype=bool, count=len(letters))  # the empty word's ids are no other word's
        old = some & (number < self.learnt)
        number[~old] = 0
        starts, sizes = np.where(old, self.starts[number], 0), np.where(old, self.sizes[number], -1)
        fresh = np.flatnonzero(~old & some)
        # A run of letters is one unit for the tokenizer, so many go in one call and their ids part after word ends.
        for k in range(0, len(fresh), CALL):
            part = fresh[k : k + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([letters[j] for j in part.tolist()])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                sizes[part] = np.diff(ends, prepend=0)
                starts[part] = self._append(ids) + ends - sizes[part]
        place = dict(zip(letters, range(len(letters)), strict=True))
        at = np.fromiter(map(place.__getitem__, stems), dtype=np.int64, count=len(stems))
        starts_, sizes_ = starts[at], sizes[at]
        odd = np.flatnonzero(sizes_ < 0).tolist()
        if odd:
            found = [np.array(e.ids, dtype=np.uint32) for j in range(0, len(odd), CALL) for e in self.tokenizer.encode_batch_fast([words[k] for k in odd[j : j + CALL]], add_special_tokens=False)]
            own = np.fromiter(map(len, found), dtype=np.int64, count=len(odd))
            starts_[odd], sizes_[odd] = self._append(np.concatenate(found)) + np.cumsum(own) - own, own
        self._with_marks(np.flatnonzero((sizes[at] >= 0) & np.fromiter(map(bool, marks), dtype=bool, count=len(marks))), marks, starts_, sizes_)
        bare = [j for j in fresh.tolist() if sizes[j] >= 0 and letters[j] not in self.known]
        self.known.update(zip([letters[j] for j in bare], range(len(self.known), len(self.known) + len(bare)), strict=True))
        while len(self.known) > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.met))
        own = slice(self.learnt, len(self.known))
        self.starts[own], self.sizes[own] = np.concatenate([starts_, starts[bare]]), np.concatenate([sizes_, sizes[bare]])
        self.learnt = len(self.known)

    def _with_marks(self, at: np.ndarray, marks: tuple[str, ...], starts: np.ndarray, sizes: np.ndarray) -> None:
        """For the words ``at`` these places the ids of their letters (starts, sizes) give way to those with the ids of their marks behind them."""
        if not len(at):
            return
        if len(self.marks) > MARKS:
            self.marks.clear()
        runs = [marks[k] for k in at.tolist()]
        different = list(dict.fromkeys(runs))
        for run in different:
            if run not in self.marks:
                self.marks[run] = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype=np.uint32)
        each = [self.marks[run] for run in different]
        own = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        place = dict(zip(different, range(len(different)), strict=True))
        run = np.fromiter(map(place.__getitem__, runs), dtype=np.int64, count=len(runs))
        pool = np.concatenate([self.flat[: self.used], *each])
        begins = np.stack([starts[at], self.used + (np.cumsum(own) - own)[run]], axis=1).ravel()
        lengths = np.stack([sizes[at], own[run]], axis=1)
        sizes[at] = lengths.sum(axis=1)
        starts[at] = self._append(_gathered(pool, begins, lengths.ravel())) + np.cumsum(sizes[at]) - sizes[at]

    def _append(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin among all that are held."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _keep(self) -> None:
        """Forget all words but the KEEP met most often."""
        kept = np.sort(np.argpartition(-self.met[: len(self.known)], KEEP)[:KEEP])
        words = list(self.known)
        self.known, self.learnt = _Numbers(zip([words[k] for k in kept.tolist()], range(KEEP), strict=True)), KEEP
        starts, sizes, met = self.starts[kept], self.sizes[kept], self.met[kept] // 2
        ids = _gathered(self.flat, starts, sizes)
        self.flat[: len(ids)], self.used = ids, len(ids)
        self.starts[:KEEP], self.sizes[:KEEP], self.met[:KEEP], self.met[KEEP:] = np.cumsum(sizes) - sizes, sizes, met, 0

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty. Equal words of the texts are brought together first and looked up once."""
        if len(self.known) > REMEMBER:
            self._keep()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = {}
        if pc.any(pc.match_substring_regex(texts, ODD)).as_py():
            odd = {k: texts[k].as_py() for k in np.flatnonzero(pc.match_substring_regex(texts, ODD)).tolist()}
            texts = pc.if_else(pc.match_substring_regex(texts, ODD), "", texts)
        split = pc.utf8_split_whitespace(texts)  # white space at an end leaves an empty word there, which has no ids
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.__getitem__, different), dtype=np.int64, count=len(different))
        del different
        self.learn()
        place = words.indices.to_numpy()
        self.met[number] += np.bincount(place, minlength=len(number)).astype(np.int32)
        starts, sizes = self.starts[number], self.sizes[number]
        bounds, out = np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy()]), []
        for k in range(0, len(texts), GATHER):
            own = bounds[k : k + GATHER + 1]
            at = place[own[0] : own[-1]]
            ids = _gathered(self.flat, starts[at], sizes[at])
            ends = np.concatenate([[0], np.cumsum(sizes[at])])[own - own[0]].tolist()
            out += [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k, text in odd.items():
            out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return out


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` of these starts and sizes, one after the other."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which serves many tasks one after the other."""
    held = sys.modules.setdefault("_wavemill_encoders", types.ModuleType("_wavemill_encoders"))
    if path not in vars(held):
        vars(held)[path] = WordEncoder(path)
    return vars(held)[path]


class Packer:
    """Packs documents as they come. ``emit(sequence, offset, document, start, length)`` takes the pieces.

    What is left of a document is one item of the pool: its start, its length and its tokens of prompt.
    """

    def __init__(self, emit: Callable[[int, int, int, int, int], None], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, lead: int = LEAD, pool: int = POOL):
        self.emit, self.limit, self.lead, self.pool_size = emit, np.array([tokens, segments, loss], dtype=np.float64), lead, pool
        self.tokens = tokens
        self.sequence, self.pieces, self.room = 0, [], self.limit.copy()
        self.items: list[tuple[int, int, int]] = []

    def add(self, document: int, length: int) -> None:
        self.items.append((document, 0, length))
        if len(self.items) >= self.pool_size:
            self.pack(self.pool_size // 8)

    def _close(self) -> list[tuple[int, int, int]]:
        """End the open sequence; short of full it is trimmed to a power of two and the rest comes back."""
        back, fill = [], sum(p[2] for p in self.pieces)
        want = fill if fill == self.tokens else 1 << (fill.bit_length() - 1)
        while fill > want:
            document, start, length = self.pieces.pop()
            keep = max(0, length - (fill - want))
            if keep:
                self.pieces.append((document, start, keep))
            back.append((document, start + keep, length - keep))
            fill -= length - keep
        offset = 0
        for document, start, length in self.pieces:
            self.emit(self.sequence, offset, document, start, length)
            offset += length
        self.sequence, self.pieces, self.room = self.sequence + 1, [], self.limit.copy()
        return back

    def pack(self, leave: int = 0) -> None:
        """Pack the pool down to ``leave`` items; to nothing if 0, then ending with sequences of powers of two."""
        items = self.items
        sizes = np.array([i[2] for i in items], dtype=np.float64)
        leads = np.array([max(0, self.lead - i[1]) for i in items], dtype=np.float64)
        left = len(items)

        def put(k: int, length: int) -> int:
            document, start, size = items[k]
            self.pieces.append((document, start, length))
            self.room -= (length, 1, max(0, length - leads[k]))
            items[k] = (document, start + length, size - length)
            sizes[k] = size - length
            leads[k] = max(0, leads[k] - length)
            return int(size == length)

        while left > leave:
            closing = self.room[0] == 0 or self.room[1] < 1
            if not closing:
                most = np.minimum(np.minimum(self.room[0], leads + self.room[2]), sizes)  # of each that can be placed
                fits = (most == sizes) & (sizes > 0)
                over = sizes > most
                if over.any() and (not self.pieces or self.room[1] == 1 or not fits.any()):
                    # An empty sequence takes a piece too long for it, the last segment should fill the room.
                    k = int(np.lexsort((sizes, np.where(over, most, -1)))[-1])
                    closing = most[k] < 1
                    if not closing:
                        put(k, int(most[k]))
                elif fits.any():
                    unit = self.room / self.limit / self.limit
                    score = np.where(fits, sizes * unit[0] + unit[1] + np.maximum(0, sizes - leads) * unit[2], -1.0)
                    left -= put(int(score.argmax()), int(sizes[score.argmax()]))
                else:
                    closing = True
            if closing:
                back = self._close()
                if back:
                    items.extend(back)
                    sizes = np.concatenate([sizes, [b[2] for b in back]])
                    leads = np.concatenate([leads, [max(0, self.lead - b[1]) for b in back]])
                    left += len(back)
        self.items = [i for i in items if i[2] > 0]
        while leave == 0 and self.pieces:
            self.items = self._close()
            if self.items:
                self.pack(0)


def _pack(batches: Iterator[pa.RecordBatch], path: str, limits: tuple[int, int, int, int]) -> Iterator[pa.RecordBatch]:
    encoder, first = worker_encoder(path), TaskContext.get().partitionId() << 40
    documents: dict[int, tuple[object, np.ndarray, int]] = {}  # ids of what isn't all packed yet, with the tokens that aren't
    rows: list[tuple] = []
    held = number = 0

    def emit(sequence: int, offset: int, document: int, start: int, length: int) -> None:
        nonlocal held
        doc_id, ids, left = documents[document]
        rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), first + sequence, offset))
        held += length
        if left == length:
            del documents[document]
        else:
            documents[document] = doc_id, ids, left - length

    def flushed() -> pa.RecordBatch:
        nonlocal held
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        rows.clear()
        held = 0
        return out

    packer = Packer(emit, *limits)
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            part = batch.slice(k, TEXTS)
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                documents[number] = doc_id, np.append(ids, np.uint32(END)).astype("<u4"), len(ids) + 1
                packer.add(number, len(ids) + 1)
                number += 1
            if held > 1 << 20:
                yield flushed()
    packer.pack()
    if rows:
        yield flushed()


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, lead: int = LEAD) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    A document is its text's ids and the id 1; null and empty texts are that id alone. A document of any length is cut
    where a sequence ends. Repeated rows are packed each. Sequence ids are unique, not gapless. Other columns
    aren't read; empty input gives no rows. ``docs`` should be a scan or a written table, whose tasks read the same
    rows in the same order each time.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frugal(_pack(batches, path, (tokens, segments, loss, lead)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts and repeated rows as in ``pack_documents``."""
    return packed(table(spark, sf_dir, "documents"))
