"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that may be near each other meet in buckets. In a bucket the bits are stored vertically, one plane a bit
position and one lane a fingerprint, and 64 distances at a time are counted by carry-save counters that stop at the
radius; blocks of lanes that have all passed it are abandoned. Buckets of a task are compared side by side,
lane i with lane i + 1, i + 2 and so on; large buckets are dealt to chunks, and pairs of chunks to tasks.

Two searches share this. ``simhash_dedup``: 64 bits of three-word shingles, radius 3. Fingerprints are cut into six parts;
within three bits they agree on three whole parts, so each goes to 20 buckets, one for every choice of three parts, and no
link is missed. ``drop_near_copies``: texts of similarity 0.8 and more by five-word shingles. Their fingerprints of 256
bits differ in about 39 places, too many for whole parts to agree, so MinHash bands make the buckets. The comparison is
only a filter there, with a wide radius: the components of what passes it are where near copies can be. The texts of a
component meet once, and the similarities of all their shingle sets are counted there exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MIN, cut, drop_cut, fresh, frugal, small_batches, sized, spread, table
from .graph import components

SEED = 42
RADIUS = 3
#: Bits of the six parts.
PARTS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a bucket that are compared in one go; larger buckets are compared chunk by chunk.
CHUNK = 1024
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of ``width``-word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text"))
        found = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64).view(np.int64)
        keep = [k for k, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found)], names=[*(batch.schema.names[k] for k in keep), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; whole texts, one pass, no shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(lambda batches: frugal(_fingerprints(batches)), "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (a row of words each): row b holds bit b of all, 64 lanes to a word, padded with zeros."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def within(planes_a, planes_b, far: np.ndarray, radius: int = RADIUS, bits: int = 64) -> np.ndarray:
    """Lanes at ``radius`` or fewer differing bits. ``planes_x(b, words)`` gives plane b of the words asked for.

    far: words of lanes that needn't be looked at. The counters are as many bits as the radius needs and start so high
    that one more than the radius runs over them. Every 8 planes the words in which all lanes are far are abandoned.
    """
    shape = far.shape
    live = np.flatnonzero(far.ravel() != ONES)
    over = far.ravel()[live]
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counts = [np.full_like(over, ONES if start >> k & 1 else 0) for k in range(width)]
    for b in range(bits):
        carry = planes_a(b, live) ^ planes_b(b, live)
        for k in range(width):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over = over | carry
        if b % 8 == 7 and b < bits - 1:
            stay = np.flatnonzero(over != ONES)
            if len(stay) < len(live):
                live, over, counts = live[stay], over[stay], [c[stay] for c in counts]
            if not len(live):
                break
    out = np.zeros(far.size, dtype=np.uint64)
    out[live] = ~over
    return out.reshape(shape)


def lanes(words: np.ndarray) -> np.ndarray:
    """Positions of the set bits of a row of words."""
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, b = np.nonzero(bits)
    return at[k] * 64 + b


def shifted_links(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside small buckets, whose fingerprints lie next to each other: lane i is compared with lane i + s.

    Words of 64 lanes in which no lane has a partner at that distance in its bucket are not touched.
    """
    n, out = len(fps), []
    planes = planes_of(fps)
    total = planes.shape[1]
    planes = np.concatenate([planes, np.zeros((len(planes), 1), dtype=np.uint64)], axis=1)
    shift = 1
    while shift < n:
        same = np.flatnonzero(bucket[:-shift] == bucket[shift:])
        if not len(same):
            break
        far = np.full(total, ONES, dtype=np.uint64)
        np.bitwise_and.at(far, same >> 6, ~(np.uint64(1) << (same & 63).astype(np.uint64)))
        step, r = divmod(shift, 64)

        def later(b: int, words: np.ndarray, step: int = step, r: int = r) -> np.ndarray:
            at = np.minimum(words + step, total)
            if not r:
                return planes[b][at]
            return (planes[b][at] >> np.uint64(r)) | (planes[b][np.minimum(at + 1, total)] << np.uint64(64 - r))

        hit = lanes(within(lambda b, words: planes[b][words], later, far, radius, len(planes)))
        if len(hit):
            out.append((hit, hit + shift))
        shift += 1
    return out


def block_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between two sets of fingerprints: every one of ``a`` against the planes of ``b``, a slice of ``a`` at a time."""
    planes, out = planes_of(b), []
    width = planes.shape[1]
    tail = np.zeros(width, dtype=np.uint64)
    if len(b) % 64:
        tail[-1] = ONES << np.uint64(len(b) % 64)
    for k in range(0, len(a), 256):
        q = a[k : k + 256]

        def query(bit: int, words: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            return np.where((q[words // width, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1), ONES, np.uint64(0))

        near = within(query, lambda bit, words: planes[bit][words % width], np.tile(tail, (len(q), 1)), radius, len(planes))
        for row in np.flatnonzero(near.any(axis=1)):
            hit = lanes(near[row])
            out.append((np.full(len(hit), k + row), hit))
    return out


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n items: the smallest item it is connected to."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_keys(fp: np.ndarray) -> np.ndarray:
    """One long for each of the 20 choices of three parts: the choice and the bits of these parts."""
    parts, at = [], 0
    for bits in PARTS:
        parts.append((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1))
        at += bits
    out = np.empty((len(fp), 20), dtype=np.uint64)
    for k, (x, y, z) in enumerate(combinations(range(6), 3)):
        out[:, k] = (np.uint64(k) << np.uint64(33)) | (parts[x] << np.uint64(22)) | (parts[y] << np.uint64(11)) | parts[z]
    return out.view(np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(fp.view(np.uint64)).ravel()), pa.array(np.repeat(fp, 20))], names=["bucket", "node"])


def _chains(nodes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(label != np.arange(len(label)))
    return nodes[label[at]], nodes[at]


def _link_rows(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, pair, side, node, words of the fingerprint) arrive by bucket and pair.

    Gives a spanning forest of the links in each bucket or pair of chunks. Without words the node is the fingerprint.
    """
    empty = np.empty(0, dtype=np.int64)

    def compare(key: np.ndarray, chunk: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        # key: number of the bucket or pair, rising; chunk: 0 for the first of a pair, 1 for the second, -1 for a whole bucket
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = (sizes <= 48) & (chunk[starts] < 0)
        step = 1 << 16
        over_edge = {int(np.searchsorted(starts, s, side="right") - 1) for s in range(step, len(key), step)}
        small[list(over_edge)] = False
        mask = np.repeat(small, sizes)
        found_a, found_b = [], []
        for at in range(0, len(key), step):  # bounds the planes at work; a bucket over an edge goes the other way below
            part = np.flatnonzero(mask[at : at + step]) + at
            if len(part) > 1:
                a, b = _chains(node[part], forest(len(part), shifted_links(key[part], fps[part], radius)))
                found_a.append(a)
                found_b.append(b)
        for g in np.flatnonzero(~small & (sizes > 1)).tolist():
            own = slice(starts[g], starts[g] + sizes[g])
            ia, ib = np.flatnonzero(chunk[own] <= 0), np.flatnonzero(chunk[own] != 0)
            if not len(ia) or not len(ib):
                continue
            pairs = [(ia[x], ib[y]) for x, y in block_links(fps[own][ia], fps[own][ib], radius)]
            x, y = _chains(node[own], forest(int(sizes[g]), pairs))
            found_a.append(x)
            found_b.append(y)
        a = np.concatenate(found_a) if found_a else empty
        b = np.concatenate(found_b) if found_b else empty
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[tuple] = []
    rows, number, last = 0, 0, None
    for batch in batches:
        bucket, pair, side, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(bucket):
            continue
        words = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4, batch.num_columns)] or [node]
        fps = np.stack(words, axis=1).view(np.uint64)
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]
        if last == (bucket[0], pair[0]):
            new[0] = False
        key = number + np.cumsum(new)
        number, last = int(key[-1]), (bucket[-1], pair[-1])
        held.append((key, side, node, fps))
        rows += len(key)
        if rows >= 1 << 19:  # compare what is complete, hold back the last bucket
            key, side, node, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut_at = int(np.searchsorted(key, key[-1]))
            if cut_at:
                yield compare(key[:cut_at], side[:cut_at], node[:cut_at], fps[:cut_at])
            held, rows = [(key[cut_at:], side[cut_at:], node[cut_at:], fps[cut_at:])], len(key) - cut_at
    if held:
        yield compare(*(np.concatenate(x) for x in zip(*held, strict=True)))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """key, pair, side and the other columns of ``rows`` (key, node, _c, ...), dealt and sorted by key and pair.

    The rows of a key are in ``_c`` chunks by a second hash, and every pair of chunks is a unit of work of its own: the
    side is 0 for rows of the first chunk, 1 for those of the second, -1 for a chunk with itself.
    """
    others = [c for c in rows.columns if c not in (key, "_c")]
    mine = F.pmod(F.xxhash64("node", key), F.col("_c")).cast("int")
    # With chunk m of c a row meets the pairs (m, j) for all j; as first where m <= j and as second else.
    pair = F.expr("transform(sequence(0, _c - 1), j -> named_struct('pair', least(_m, j) * _c + greatest(_m, j), 'side', case when j = _m then -1 when _m < j then 0 else 1 end))")
    units = rows.withColumn("_m", mine).withColumn("_p", F.explode(pair)).select(key, F.col("_p.pair").cast("long").alias("pair"), F.col("_p.side").alias("side"), *others)
    return units.repartition(key, "pair").sortWithinPartitions(key, "pair")


def bucket_links(rows: DataFrame, chunk: int = CHUNK, radius: int = RADIUS) -> DataFrame:
    """a, b: nodes that connect all within ``radius`` in a bucket. ``rows``: a written table (bucket, node, words).

    Buckets of one node are dropped after a count. A bucket of more than ``chunk`` becomes chunks, see ``dealt``.
    """
    chunks = F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_c")
    sizes = cut(rows.groupBy("bucket").agg(chunks, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    return dealt(rows.join(sized(sizes), "bucket"), "bucket").mapInArrow(lambda batches: frugal(_link_rows(batches, radius)), "a long, b long")


def near_links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b: fingerprints (signed longs) that connect all within RADIUS bits. ``distinct``: column fp, no repeats."""
    rows = distinct.select("fp").mapInArrow(lambda batches: frugal(_tables(batches)), "bucket long, node long")
    return bucket_links(cut(rows, "tables"), chunk)


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """_node, component_id (written): of nodes (node, least), the smallest ``least`` in each component of the links."""
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Written first: a join of two scans is one whose skewed keys, large components, can be split.
    rooted = cut(rooted, "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return cut(rooted.join(least, "root").select(F.col("node").alias("_node"), "component_id"), "components")


def near_components(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (doc_id, fp) with component_id, the smallest doc_id reachable over links.

    Equal fingerprints are one node however many rows have them.
    """
    nodes = cut(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    ids = classes(nodes, near_links(nodes.withColumnRenamed("node", "fp"), chunk))
    return rows.join(ids, rows["fp"] == ids["_node"]).drop("_node")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. Repeated rows
    come back repeated. A null doc_id never names a component unless it has no other id. Other columns are not
    read; empty input gives no rows.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    return near_components(rows, chunk).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


# The wide search: five-word shingles, similarity 0.8, fingerprints of four words, radius of the filter, and MinHash bands.
# At similarity 0.8 two texts share a band with probability 1 - (1 - 0.8**3)**12 = 0.9998. They differ in 39 of 256 bits on
# average (standard deviation 5.7), texts of four and five shingles in 48 (6.2); unrelated ones in 128 (8).
WIDE, WIDE_WORDS, WIDE_RADIUS, BANDS, BAND_ROWS = 5, 4, 72, 12, 3
#: Similarity of near copies is NEAR[0] / NEAR[1] and more.
NEAR = (4, 5)
#: Shingles of a chunk of texts that are compared in one go, about; of texts of many words fewer than CHUNK make a chunk.
HELD = 1 << 19
#: A shingle in more sets than FEW is a column of a matrix, of which SLAB are multiplied at a time.
FEW, SLAB = 16, 2048


def wide_shingles(text: bytes) -> tuple[bytes, np.ndarray] | None:
    """The words joined by spaces and the hashes of their different shingles, sorted; None for a text without words."""
    words = text.lower().split()
    if not words:
        return None
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WIDE:
        return joined, np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *(ends[: len(words) - WIDE]).tolist()], (ends[WIDE - 1 :] - 1).tolist()
    return joined, np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def wide_signature(text: bytes) -> tuple[int, np.ndarray, np.ndarray, int] | None:
    """Node (a hash of the words), four words of fingerprint, the band keys and the number of shingles; None for a text without words."""
    found = wide_shingles(text)
    if found is None:
        return None
    joined, h = found
    ones = np.zeros(64 * WIDE_WORDS, dtype=np.int64)
    for k in range(0, len(h), 4096):
        part = np.stack([remixed(h[k : k + 4096], w) for w in range(WIDE_WORDS)], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")
    keys = np.zeros(BANDS, dtype=np.uint64)
    for b in range(BANDS):
        for r in range(BAND_ROWS):
            keys[b] = remixed(keys[b : b + 1], 100 + b)[0] ^ remixed(h, 10 + b * BAND_ROWS + r).min()
    return xxhash.xxh64_intdigest(joined, 1), fp, keys, len(h)


def remixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = (h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text as it is), node, size (its number of shingles), f0.. and keys of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(at, x) for at, t in enumerate(batch.column(2)) if (x := wide_signature(t.as_py() or b""))]
            found, at = [x for _, x in made], pa.array([k for k, _ in made], pa.int64())
            if found:
                fps = np.stack([x[1] for x in found]).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([x[2] for x in found]).view(np.int64)))
                nodes = np.array([x[0] for x in found], dtype=np.uint64).view(np.int64)
                sizes = pa.array([x[3] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(nodes), sizes, *(pa.array(fps[:, k].copy()) for k in range(WIDE_WORDS)), keys], names=["doc_id", "row", "node", "size", *(f"f{k}" for k in range(WIDE_WORDS)), "keys"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, row long, node long, size long, " + ", ".join(f"f{k} long" for k in range(WIDE_WORDS)) + ", keys array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary")).mapInArrow(lambda batches: frugal(run(batches)), schema)


def set_links(sets: list[np.ndarray], split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets of similarity NEAR and more, exactly; each set is sorted and without repeats.

    ``split``: only pairs of one of the first so many sets with one of the others. What two sets have in common is
    counted over shingles: those in a few sets by their pairs, those in more by products of matrices of zeros and ones.
    """
    low, high = NEAR
    n, sizes = len(sets), np.array([len(x) for x in sets])
    rows, first = (split, split) if split else (n, 0)
    shingle, item = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, item = shingle[order], item[order]
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    times = np.diff(np.r_[starts, len(shingle)])
    column, times = np.repeat(np.arange(len(times)), times), np.repeat(times, times)
    common = np.zeros(rows * (n - first), dtype=np.int64)
    few = (times > 1) & (times <= FEW)
    item_, column_ = item[few], column[few]
    for shift in range(1, FEW):
        at = np.flatnonzero(column_[:-shift] == column_[shift:])
        if not len(at):
            break
        x, y = item_[at], item_[at + shift]
        if split:
            across = (x < split) & (y >= split)
            x, y = x[across], y[across]
        common += np.bincount(x * (n - first) + y - first, minlength=len(common))
    common = common.reshape(rows, n - first)
    item, column = item[times > FEW], column[times > FEW]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        part = slice(*np.searchsorted(column, [k, k + SLAB]))
        held = np.zeros((n, SLAB), dtype=np.float32)
        held[item[part], column[part] - k] = 1
        common += (held[:rows] @ held[first:].T).astype(np.int64)
    # Of i in both, i / (x + y - i) is at least low / high.
    near = (low + high) * common >= low * (sizes[:rows, None] + sizes[first:])
    x, y = np.nonzero(near if split else np.triu(near, 1))
    return x, y + first


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, pair, side, node, text) arrive by root and pair; a spanning forest of the links in each pair of chunks."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(side: list[int], node: list[int], sets: list[np.ndarray]) -> None:
        order = sorted(range(len(side)), key=side.__getitem__)
        split = sum(s == 0 for s in side)
        if len(side) > 1 and (side[order[0]] < 0 or 0 < split < len(side)):
            pairs = set_links([sets[k] for k in order], split)
            found.append(_chains(np.array([node[k] for k in order], dtype=np.int64), forest(len(order), [pairs])))

    last, unit = None, ([], [], [])
    for batch in batches:
        roots, pairs, sides, nodes = (batch.column(k).to_pylist() for k in range(4))
        for root, pair, side, node, text in zip(roots, pairs, sides, nodes, batch.column(4), strict=True):
            if (root, pair) != last:
                compare(*unit)
                last, unit = (root, pair), ([], [], [])
            for held, x in zip(unit, (side, node, wide_shingles(text.as_py())[1]), strict=True):
                held.append(x)
        if found:
            a, b = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
            found.clear()
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
    compare(*unit)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])


def copy_links(docs: DataFrame, nodes: DataFrame, tables: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b: nodes of similarity NEAR and more, enough links to connect all such that share a bucket of ``tables``.

    ``nodes``: a written table of node, least (the smallest doc_id and its row) and size, its number of shingles. Fingerprints of a
    bucket within the wide radius are candidates. Only texts in a component of candidates are sent, one of each node, and
    once unless the component is large; all pairs of a component are verified, whether or not they share a bucket.
    """
    roots = components(cut(bucket_links(tables, chunk, WIDE_RADIUS), "candidate-links"))
    wanted = nodes.join(sized(roots), "node").select("root", "node", "size", F.coalesce("least.doc_id", F.lit(LONG_MIN)).alias("_id"), F.col("least.row").alias("row"))
    wanted = cut(wanted, "candidates")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") / HELD)).cast("int").alias("_c")
    sizes = cut(wanted.groupBy("root").agg(chunks), "candidate-sizes")
    members = cut(wanted.join(sizes, "root").drop("size"), "members")
    texts = docs.select(F.coalesce("doc_id", F.lit(LONG_MIN)).alias("_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(sized(members), ["_id", "row"]).dropDuplicates(["_id", "row"]).select("root", "node", "_c", "text")
    return cut(dealt(texts, "root").mapInArrow(lambda batches: frugal(_similar(batches)), "a long, b long"), "similar")


def drop_near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each component of near copies, that of the smallest doc_id; columns unchanged.

    Near: sets of five-word shingles of similarity 0.8 and more. Pairs are found as in the module's docstring and verified
    exactly, so no less similar texts are linked. Texts without words are not near anything and stay. A row is known by
    its doc_id and text: other texts of a dropped row's id stay, of several rows with the smallest id one text does, and
    rows that are equal in both stay or go together. A null doc_id counts as the smallest.
    """
    words = [f"f{k}" for k in range(WIDE_WORDS)]
    rows = cut(wide_signatures(docs.select("doc_id", "text")), "signatures")
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.min("size").alias("size")), "nodes")
    keyed = rows.dropDuplicates(["node"]).select(F.posexplode("keys").alias("b", "key"), "node", *words)
    tables = cut(keyed.select(F.xxhash64("b", "key").alias("bucket"), "node", *words), "bands")
    links = copy_links(docs, nodes, tables, chunk)
    drop_cut(tables)
    ids = classes(nodes, links)
    same = F.col("doc_id").eqNullSafe(F.col("component_id.doc_id")) & (F.col("row") == F.col("component_id.row"))
    found = rows.join(ids, rows["node"] == ids["_node"]).where(~same)
    name, row = fresh(docs, "__gone", "__row")
    gone = cut(found.select(F.col("doc_id").alias(name), F.col("row").alias(row)).distinct(), "near-copies")
    return docs.join(sized(gone), F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(row)), "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts and repeated rows as in ``simhash_dedup``."""
    return simhash_dedup(spread(table(spark, sf_dir, "documents")))
