"""The operators' results against SQL or plain versions, and their methods against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wavemill.llm import chat, common, exact_dedup, graph, mixing, packing, pii, quality_classifier, quality_rules, registry, sharding, simhash, substring_dedup


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


def texts(spark, small):
    return dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())


def capacity(sizes, shards):
    """Least capacity by trying all cuts with dynamic programming."""
    sums = np.r_[0, np.cumsum(sizes)]
    best = sums.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))])
    return int(best[-1])


def test_capacity_is_minimal(spark):
    rng = random.Random(4)
    for n, shards in ((40, 5), (3, 5), (60, 7)):
        rows = sorted((rng.getrandbits(64) - 2**63, rng.choice([9, 30, 400])) for _ in range(n))
        rows[n // 2] = (rows[n // 2][0], 2000)
        found, cuts = sharding.find_cuts(spark.createDataFrame(rows, "h long, bytes long"), shards)
        loads = [0] * shards
        for h, b in rows:
            loads[sum(h >= c for c in cuts if c != common.LONG_MAX)] += b
        assert found == capacity([b for _, b in rows], shards) and max(loads) <= found


def test_sharding_query(spark, small):
    rows = sharding.op1_sharding(spark, small).toPandas()
    t = texts(spark, small)
    assert rows.doc_id.map(lambda d: len(t[d].encode()) + 8).tolist() == rows["size"].tolist() and rows.doc_id.map(lambda d: zlib.crc32(t[d].encode())).tolist() == rows.text_crc32.tolist()
    loads = rows.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() < 1.6 * loads.mean()
    assert rows.assign(t=rows.doc_id.map(t)).groupby("t").shard.nunique().max() == 1


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(150, 151), (151, 150), (160, 160)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(170, links)
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [16, 1024])
def test_simhash_finds_every_link(spark, chunk):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(30)} | set(base)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(rows, chunk).collect()}
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    links = [(a, int(b)) for a in range(len(u)) for b in np.flatnonzero(np.bitwise_count(u[a] ^ u[a + 1 :]) <= 3) + a + 1]
    assert got == dict(enumerate(union_find(len(u), links)))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 40))
@settings(max_examples=40, deadline=None)
def test_bit_sliced_distance(values, radius):
    a = np.array(values, dtype=np.uint64)[:, None]
    q = a[:3]
    got = {(int(x), int(y)) for k, m in simhash.block_links(q, a, radius) for x, y in zip(k, m, strict=True)}
    assert got == {(x, y) for x in range(len(q)) for y in range(len(a)) if int(q[x, 0] ^ a[y, 0]).bit_count() <= radius}


def test_fingerprint_by_hand():
    import xxhash

    text = "The cat sat ON the mat the cat sat"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)


def test_wide_search_finds_edited_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        edited = list(words)
        for _ in range(2):
            edited[rng.randrange(200)] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(40)} <= left and len(left) <= 41


@pytest.mark.parametrize("chunk", [8, 1024])
def test_near_copies_match_brute_force(spark, chunk):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for n in [9, 15] * 15 + [54, 104, 204, 304] * 25:
        base = [rng.choice(vocabulary) for _ in range(n)]
        rows.append(base)
        for _ in range(2):
            low = rng.uniform(0.75, 0.85)
            extra = max(1, round((n - 4) * (1 / low - 1)))  # words after the end: similarity about low
            rows.append(base + [rng.choice(vocabulary) for _ in range(extra)])
    rng.shuffle(rows)
    sets = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = {k for k, root in enumerate(union_find(len(sets), links)) if k == root}
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs, chunk).collect()} == want


def test_near_copies_are_known_by_id_and_text(spark):
    _, words = words_maker(41, 10**6)
    one, two, other = words(60), words(60), words(60)
    text = lambda w, *extra: " ".join([*w, *extra])
    rows = [(1, text(one)), (5, text(one, "edited")), (5, text(other)), (6, text(two)), (7, text(two)), (7, text(two)), (8, text(other)), (8, text(other, "x")), (None, text(words(30)))]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in left) == [(0, 30), (1, 60), (5, 60), (6, 60)]


@given(st.text(alphabet="a@.+-_1259 (),é", max_size=80))
@settings(max_examples=150, deadline=None)
def test_base_patterns_match_the_plain_ones(text):
    # Java's possessive forms exist in Python's re too, all but the anchor at the last match's end.
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in plain.items():
        want = [m.span() for m in re.finditer(pattern, text)]
        got, at, compiled = [], 0, [re.compile(pii.BASE[kind].replace(r"|\G", "")), re.compile(pii.BASE[kind].replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "").replace(r"(?:(?<![0-9])|\G)", ""))]
        while at <= len(text):
            here = compiled[1].match(text, at) if got and got[-1][1] == at else None
            m = here or compiled[0].search(text, at)
            if not m:
                break
            got.append(m.span())
            at = m.end()
        assert got == want


def test_personal_data_query(spark, small):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]

    t = texts(spark, small)
    for r in pii.op4_pii(spark, small).collect():
        want = base(t[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_boosted_candidates(spark):
    rows = [(0, "write to john at example dot com now"), (1, "call (659) 555-3949 soon"), (2, "card 4111.1111.1111.1111"), (3, "the 4111.1111.1111.1112 of it"), (4, "he was at home.The day"), (5, "on 2021-10-12 and 300.1.1.1")]
    model = pii.fit(spark)
    got = {r.doc_id: r.a for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model).selectExpr("doc_id", pii.joined("spans_all") + " a").collect()}
    assert got == {0: "email:9:32", 1: "phone:5:19", 2: "card:5:24", 3: "", 4: "", 5: ""}


def test_selection_matches_brute_force(spark):
    """Overlap rules on crowded texts, against all pairs in plain Python; a model that lets everything pass."""
    rng = random.Random(5)
    pieces = ["john at example dot com ", "(659) 555-3949 ", "659-555-3949", " 4111.1111.1111.1111", "1 . 2 . 3 . 4 ", "10,0,0,1", "0044 20 7946 0018 ", "10.0.0.7", "a@b.co", "+1 (042) 555-7845", " x", ".", "4111 1111 1111 1111", "12-34-56"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.choice([3, 12, 200])))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.Model("cast(pmod(xxhash64(f.size, f.digits, f.kind), 5) as double)", [0.0] * 4, [])
    got = {r.doc_id: r.a.split(",") for r in pii.find_personal_data(docs, model).selectExpr("doc_id", pii.joined("spans_all") + " a").collect()}
    margin = pii.let(pii.features("c.k", "c.x", "c.l"), "f", model.margin)
    raw = docs.selectExpr("doc_id", f"filter({pii.spans_of('text')}, x -> {pii.valid('x')}) b", f"filter({pii.scored_as(pii.proposals('text'), margin)}, c -> {pii.checked('c')}) p").collect()
    over = lambda a, b: a.s < b.e and b.s < a.e
    added = 0
    for r in raw:
        free = [c for c in r.p if not any(over(c, b) for b in r.b)]
        mail = [c for c in free if c.k == 0]
        numbers = sorted((c for c in free if c.k and not any(over(c, m) for m in mail)), key=lambda c: (c.s, c.e, c.k, c.x, c.l))
        stay = [c for i, c in enumerate(numbers) if not any(over(c, o) and (o.m > c.m or (o.m == c.m and j < i)) for j, o in enumerate(numbers) if j != i)]
        want = [f"{pii.KINDS[c.k]}:{c.s}:{c.e}" for c in sorted([*r.b, *mail, *stay], key=lambda c: (c.s, c.k, c.e))]
        added += len(mail) + len(stay)
        assert got[r.doc_id] == (want or [""])
    assert added > 200


def test_corpus_gives_examples(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pii.mined(docs, most=40).toPandas()
    assert {(0, 1.0), (1, 1.0), (2, 0.0)} <= set(zip(rows.kind, rows.label, strict=True)) and rows.groupby(["kind", "label"]).size().max() <= 40
    report = pii.fit(spark, docs).report
    assert [r["kind"] for r in report] == pii.KINDS and all(r["precision"] >= pii.PRECISION for r in report)


@given(st.text(alphabet="<|\\>ia_mstred\n é", max_size=40), st.text(alphabet="user%0A\n<|", max_size=8))
@settings(max_examples=200, deadline=None)
def test_chat_turns_read_back(text, role):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text) and chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


def test_chat_masks(spark):
    turns = [(1, 1, "assistant", "<|im_end|>ok"), (1, 0, "user", "hi"), (2, 0, "assistant", None), (None, 3, None, "<|endoftext|>")]
    rows = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    enc = chat.encoding(chat.ranks_path())
    placed = chat.placed(rows).where("conv_id = 1").orderBy("turn").collect()
    assert [r.offset for r in placed] == [0, placed[0].n_tokens]
    seq = np.concatenate([np.frombuffer(r.ids, "<u2") for r in placed])
    mask = np.concatenate([np.unpackbits(np.frombuffer(r.mask, np.uint8), bitorder="little")[: r.n_tokens] for r in placed]).astype(bool)
    assert chat.read_back(enc, seq, mask) == [("user", "hi", ""), ("assistant", "<|im_end|>ok", "<|im_end|>ok")]
    assert enc.decode(seq.tolist()) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<\\|im_end|>ok<|im_end|>\n"
    by_id = {r.conv_id: r for r in chat.digest_conversations(rows).collect()}
    assert by_id[2].loss_chars == 0 and by_id[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and by_id[None].n_turns == 1
    assert chat.digest_conversations(rows.limit(0)).count() == 0


def plain_counts(text):
    w = re.findall(r"[^\x20\t-\r]+", text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_query(spark, small):
    t = texts(spark, small)
    for r in quality_rules.op8_quality_rules(spark, small).collect():
        n, *rest = plain_counts(t[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n) and not (r.base_failed and r.kept)


def test_distance_by_hand(spark):
    def jsd(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        return np.sqrt(sum(sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) for a in (p, q)) / 2)

    row = spark.createDataFrame([([5, 0, 3], [1, 1, 6], [0, 0, 0])], "a array<long>, b array<long>, c array<long>").select(quality_rules.distance("a", "b"), quality_rules.distance("a", "c"), quality_rules.distance("a", "a")).first()
    assert np.isclose(row[0], jsd([5, 0, 3], [1, 1, 6])) and row[1] is None and np.isclose(row[2], 0)


def test_packing_query(spark, small):
    from tokenizers import Tokenizer

    tokenizer, t = Tokenizer.from_file(packing.tokenizer_path()), texts(spark, small)
    rows = packing.op9_packing(spark, small).toPandas()
    for doc_id, pieces in rows.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(t[doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = pieces.sort_values("start")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0] and pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
    fills = rows.groupby("sequence_id").length.sum()
    assert fills.max() <= 2048 and sum(0 if f & (f - 1) == 0 else 2048 - f for f in fills) == 0


def loss_of(start, length, lead):
    return max(0, length - max(0, lead - start))


def plain_packing(lengths, tokens, segments, loss, lead):
    """The packer's rule for documents that are all in the pool, written with loops over plain numbers."""
    items, out, sequence = [(k, 0, n) for k, n in enumerate(lengths)], [], 0
    while items:
        taken, room = [], [tokens, segments, loss]

        def place(item, n, taken=taken, room=room):
            d, a, size = item
            taken.append((d, a, n))
            for j, x in enumerate((n, 1, loss_of(a, n, lead))):
                room[j] -= x
            at = items.index(item)
            items[at : at + 1] = [(d, a + n, size - n)] if size > n else []

        while items and room[0] and room[1]:
            most = [min(room[0], max(0, lead - a) + room[2], n) for _, a, n in items]
            over = [(m, i[2], k) for k, (i, m) in enumerate(zip(items, most, strict=True)) if i[2] > m]
            fits = [i for i, m in zip(items, most, strict=True) if i[2] == m]
            if over and (not taken or room[1] == 1 or not fits):
                m, _, k = max(over)
                if m < 1:
                    break
                place(items[k], m)
            elif fits:
                score = lambda i: i[2] * (room[0] / tokens / tokens) + room[1] / segments / segments + loss_of(i[1], i[2], lead) * (room[2] / loss / loss)
                place(max(fits, key=score), max(fits, key=score)[2])
            else:
                break
        fill = sum(n for _, _, n in taken)
        want = fill if fill == tokens else 1 << (fill.bit_length() - 1)
        while fill > want:
            d, a, n = taken.pop()
            keep = max(0, n - (fill - want))
            if keep:
                taken.append((d, a, keep))
            items.append((d, a + keep, n - keep))
            fill -= n - keep
        out += [(sequence, *piece) for piece in taken]
        sequence += 1
    return sorted(out)


def packs(lengths, pool, **limits):
    out = []
    packer = packing.Packer(lambda *x: out.append(x), pool=pool, **limits)
    for k, n in enumerate(lengths):
        packer.add(k, n)
    packer.pack()
    return out


@given(st.lists(st.integers(1, 700), min_size=1, max_size=60), st.integers(2, 9), st.integers(20, 130), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_packer_keeps_every_limit(lengths, segments, loss, lead):
    out = packs(lengths, 16, tokens=128, segments=segments, loss=loss, lead=lead)
    got = {}
    for s, o, d, a, n in out:
        got.setdefault(s, []).append((o, n, loss_of(a, n, lead)))
    for pieces in got.values():
        pieces.sort()
        fill = sum(n for _, n, _ in pieces)
        assert fill <= 128 and fill & (fill - 1) == 0 and len(pieces) <= segments and sum(x for _, _, x in pieces) <= loss
        assert [o for o, _, _ in pieces] == [sum(n for _, n, _ in pieces[:k]) for k in range(len(pieces))]
    for k, n in enumerate(lengths):
        own = sorted((a, m) for _, _, d, a, m in out if d == k)
        assert sum(m for _, m in own) == n and all(x + m == y for (x, m), (y, _) in zip(own, own[1:], strict=False))


@given(st.lists(st.integers(1, 300), min_size=1, max_size=14, unique=True), st.integers(2, 5), st.integers(40, 128), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_packer_follows_the_plain_rule(lengths, segments, loss, lead):
    limits = {"tokens": 128, "segments": segments, "loss": loss, "lead": lead}
    got = packs(lengths, 10**6, **limits)
    want = plain_packing(lengths, **limits)
    assert sorted((s, d, a, n) for s, _, d, a, n in got) == want


def test_limit_on_loss_binds():
    out = packs([5000] * 40 + [50] * 40, 10**6)
    per = {}
    for s, _, _, a, n in out:
        x = per.setdefault(s, [0, 0])
        x[0], x[1] = x[0] + n, x[1] + loss_of(a, n, packing.LEAD)
    assert max(x[1] for x in per.values()) == packing.LOSS < packing.TOKENS == max(x[0] for x in per.values())
    free = packs([5000] * 40 + [50] * 40, 10**6, loss=packing.TOKENS)
    assert {s: n for s, _, _, _, n in free} != {s: n for s, _, _, _, n in out}


SCRIPTS = "abzAZ éßİŉſ ΑΣς жё \u0958\u095f\u09dc\u0a5b\u0915\u093c \u05d0\u05b4 \ufb1d ﬁ 한각 漢字 ไทย \u0301\u0308 09 .,'\u2019 \u1e9e\u01c5 \U0001f600"


@given(st.lists(st.text(alphabet=SCRIPTS.replace(" ", ""), min_size=1, max_size=6), min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_words_met_bare_change_no_ids(words):
    path = packing.tokenizer_path()
    enc = packing.worker_encoder(path)
    enc.forget()
    for text in (" ".join(words), " ".join(w + m for w in words for m in (".", ",", "", "\u0301", ".,", "###", "'", "!'s", "<|", "&\u0301")), " ".join(w.upper() + "." for w in words), " ".join(words)):
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_word_encoder_equals_tokenizer(text):
    enc = packing.worker_encoder(packing.tokenizer_path())
    words = text + " " + text.upper() + ".,"
    assert enc.encode([words])[0].tolist() == enc.tokenizer.encode(words, add_special_tokens=False).ids


def test_packed_ids_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120).union(spark.createDataFrame([(-1, "\u0958, \u0958 \u0921\u093c, \u0921\u093c", "hi", "x", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    whole = []
    for n in (1, 7):
        rows = packing.pack_documents(docs.repartition(n)).toPandas().sort_values(["doc_id", "start"])
        whole.append(rows.groupby("doc_id").ids.agg(lambda x: b"".join(bytes(i) for i in x)).to_dict())
    assert whole[0] == whole[1]


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 120))
@settings(max_examples=100, deadline=None)
def test_knapsack_is_exact(items, budget):
    lengths, counts = [x[0] for x in items], [x[1] for x in items]
    take = mixing.fill(lengths, counts, budget)
    reach = {0}
    for length, count in items:
        reach = {r + k * length for r in reach for k in range(count + 1)}
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(t * x for t, x in zip(take, lengths, strict=True)) == max(r for r in reach if r <= budget)


def test_targets_and_mix(spark, small):
    assert mixing.targets([10, 100, 100], [3.0, 1.0, 2.0]) == [30.0, 60.0, 120.0]
    rows = mixing.op10_mixing(spark, small).toPandas()
    source = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").collect())
    t = texts(spark, small)
    assert rows.doc_id.map(lambda d: len(re.findall(r"[^\x20\t-\r]+", t[d]))).tolist() == rows["size"].tolist()
    by = rows.assign(s=rows.doc_id.map(source)).groupby("s").agg(target=("target", "max"), taken=("taken", "sum"), size=("size", "sum"), own=("source_size", "max"))
    assert (by["size"] == by.own).all() and abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 20).all() and (rows.taken <= 3 * rows["size"]).all()


def test_mix_matches_plain_plan(spark):
    """Copies of every source and size against the plan made in plain Python, with ids and whole rows repeated."""
    rng = random.Random(14)
    rows = [(rng.randrange(150), " ".join(["w"] * rng.choice([0, 1, 2, 3, 5, 8, 40, 90])), rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(3)) for _ in range(700)]
    rows += [(900, "one two three four", "b", 0)] * 50 + [(901, None, "c", 0), (None, "x y", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    sizes = {}
    for _, t, s, _ in rows:
        sizes.setdefault(s, []).append(len((t or "").split()))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([sum(sizes[s]) for s in names], [k % 3 + 1.0 for k in range(len(names))])
    want = {}
    for s, goal in zip(names, goals, strict=True):
        length, count = np.unique(sizes[s], return_counts=True)
        copies, extra = mixing.plan_source(length, count, goal)
        want |= {(s, int(z)): int(copies * c + e) for z, c, e in zip(length, count, extra, strict=True) if copies * c + e}
        assert abs(sum(want.get((s, int(z)), 0) * int(z) for z in length) - goal) <= 1
    for mixed in (mixing.mixed_documents(docs), mixing.mixed_documents(docs.repartition(7))):
        got = {}
        for r in mixed.collect():
            key = r.source, len((r.text or "").split())
            got[key] = got.get(key, 0) + 1
        assert got == want
    taken = {}
    for r in mixing.mix(docs.select("doc_id", "text", "source")).groupBy("size").agg(F.sum("taken").alias("t")).collect():
        taken[r["size"]] = r.t
    assert taken == {z: sum(n * z for (_, y), n in want.items() if y == z) for z in {len((t or "").split()) for _, t, _, _ in rows}}


def test_one_repeated_row_meets_its_target(spark):
    rows = [(1, "one two three four", "a")] * 50 + [(k, "x " * 30, "b") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r.source: r.n for r in mixing.mixed_documents(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    goal = mixing.targets([200, 300], [1.0, 2.0])[0]
    assert abs(4 * by["a"] - goal) < 4


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_classifier.op5_quality(spark, d).toPandas().merge(labels.toPandas(), on="doc_id")
    fitted = {r._id for r in quality_classifier.labelled(labels).where("_fold = 0").collect()}
    held = rows[~rows.doc_id.isin(fitted)]
    assert held[held.quality == 1].kept.mean() > 0.995 and held[held.quality == 0].kept.mean() < 0.05
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(500)
    assert quality_classifier.classify(docs, labels, k=100).where("kept").count() == quality_classifier.classify(docs, labels, share=0.2).where("kept").count() == 100


def plain_grams(text):
    """Buckets of one text with plain loops."""
    import xxhash

    big, n = 2**64, quality_classifier.BUCKETS
    mix = lambda x: ((y := ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % big) ^ (y >> 29)) % big
    words = text.encode().split()
    shapes = []
    for w in words:
        for pattern, to in ((rb"[A-Z]+", b"A"), (rb"(?:[a-z]|[\x80-\xff])+", b"a"), (rb"[0-9]+", b"9"), (rb"([^Aa9])\1+", rb"\1\1")):
            w = re.sub(pattern, to, w)
        shapes.append(xxhash.xxh64_intdigest(w))
    h = [xxhash.xxh64_intdigest(w.lower()) for w in words]
    out = [x % n for x in h]
    for k in range(len(words) - 1):
        out.append(n + mix((h[k] * 0x9E3779B97F4A7C15 + h[k + 1]) % big) % n)
        out.append(2 * n + mix((shapes[k] * 0x9E3779B97F4A7C15 + shapes[k + 1] * 3 + (words[k] == words[k + 1])) % big) % n)
    return out


def test_resampling_matches_plain_version(spark, small):
    """Counts, log ratios, weights, keys and the k chosen, against loops over plain lists."""
    docs = spark.read.parquet(f"{small}/documents.parquet").union(spark.createDataFrame([(-5, None, "en", "x", 0), (-6, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    fold = {r._id: r._good for r in quality_classifier.labelled(labels).where("_fold = 0").collect()}
    b, rows = quality_classifier.BUCKETS, docs.select("doc_id", "text", quality_classifier.gumbel().alias("g")).collect()
    raw, target = np.zeros(3 * b), np.zeros(3 * b)
    grams = {r.doc_id: plain_grams(r.text or "") for r in rows}
    for d, own in grams.items():
        for g in own:
            raw[g] += 1
            target[g] += bool(fold.get(d))
    ratio = np.zeros(3 * b)
    for k in range(3):
        part = slice(k * b, (k + 1) * b)
        share = target[part].sum() / raw[part].sum()
        ratio[part] = np.log((target[part] + share + quality_classifier.PSEUDO) / (raw[part] * share + share + quality_classifier.PSEUDO))
    weight = {d: sum(ratio[g] for g in own) for d, own in grams.items()}
    key = {r.doc_id: weight[r.doc_id] + r.g for r in rows}
    for k in (1, 40, 150):
        got = {r.doc_id: r for r in quality_classifier.classify(docs, labels, k=k).collect()}
        assert all(np.isclose(got[d].log_weight, weight[d], atol=1e-6) and np.isclose(got[d].sample_key, key[d], atol=1e-6) for d in key)
        assert {d for d, r in got.items() if r.kept} == set(sorted(key, key=key.get)[-k:])
    kept = {r.doc_id for r in quality_classifier.drop_low_quality(docs, labels, k=40).collect()}
    assert kept == set(sorted(key, key=key.get)[-40:])


def test_rank_threshold(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) - 2**63 for _ in range(500)] + [5] * 100 + [-(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [common.rank_threshold(rows, "v", k) for k in (1, 250, 602, 603, 0)] == [sorted(values)[0], sorted(values)[249], sorted(values)[601], None, None]


def words_maker(seed, size=4000):
    rng = random.Random(seed)
    return rng, lambda n: [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("chunk", [2, 1024])
def test_pasted_passages_are_found_whole(spark, chunk):
    """Every word of a passage of 50 to 400 words, pasted anywhere, is removed but in its first place; nothing else is."""
    rng, words = words_maker(8, 10**6)
    rows, want, key = [], {}, 0
    for n in [50, 51, 60, 90, 120, 400] * 6:
        passage = words(n)
        for copy in range(3):
            before, after = words(rng.randrange(0, 90)), words(rng.randrange(0, 90))
            breaks = [rng.choice([" ", "\n"]) for _ in range(len(before) + n + len(after))]
            all_words = [*before, *passage, *after]
            rows.append((key, "".join(w + s for w, s in zip(all_words, breaks, strict=True))))
            want[key] = passage if copy else []
            key += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs, chunk)
    removed = {}
    for r in found.where("removed").collect():
        removed.setdefault(r.doc_id, []).append((r.start, r.end))
    text = dict(rows)
    assert {k: [w for a, b in sorted(removed.get(k, [])) for w in text[k][a:b].split()] for k in text} == want
    cleaned = dict(substring_dedup.remove_passages(docs, found).select("doc_id", "text").collect())
    for k, t in cleaned.items():
        assert len(t.split()) == len(text[k].split()) - len(want[k])


def test_paragraphs_match_brute_force(spark):
    """Clusters of similar paragraphs, edits inside, against all pairs; recall of links at similarity 0.8 to 0.9."""
    rng, words = words_maker(31, 10**6)
    lines, rows = [], []
    for n in [20, 24, 30, 45, 60, 100, 200] * 12:
        base = words(n)
        lines.append(base)
        for _ in range(2):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                edited[rng.choice([0, n - 1, rng.randrange(n)])] = words(1)[0]
            lines.append(edited)
    rng.shuffle(lines)
    for k, line in enumerate(lines):
        rows.append((k, " ".join(words(3)) + "\n" + " ".join(line) + "\n" + " ".join(words(4))))
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    roots = union_find(len(sets), links)
    docs = substring_dedup.named_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    _, units = substring_dedup.units(docs)
    members = substring_dedup.bucket_classes(units)
    detail = substring_dedup.details(docs, substring_dedup.line_places(members))
    found = {r.doc_id: r.first_doc_id for r in substring_dedup.repeated_lines(units, members, detail).collect()}
    want = {k: r for k, r in enumerate(roots) if roots.count(r) > 1}
    assert len(want) > 100 and found == want


def test_short_lines_are_left_alone(spark):
    _, words = words_maker(5, 10**6)
    rows = [(k, " ".join(words(40)) + "\nthis line of nine words stands in every text\n" + " ".join(words(40))) for k in range(20)]
    assert substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_phrase_before_a_passage_hides_no_start():
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    powers = substring_dedup.Powers()
    low = lambda p: int(substring_dedup.shingles_of(substring_dedup.words_of(" ".join(p).encode(), powers)[0])[0])
    phrase = min((words(5) for _ in range(3000)), key=low)
    for _ in range(40):
        passage = words(15) + phrase + words(31)
        one, two = words(40) + phrase + passage + words(40), words(40) + passage + words(40)
        texts = [substring_dedup.Text(" ".join(x).encode(), powers) for x in (one, two)]
        a, b = (set(t.digests(t.runs, t.runs + substring_dedup.WORDS).tolist()) for t in texts)
        assert a & b


def test_similar_sets_match_brute_force():
    rng = random.Random(3)
    base = [frozenset(rng.sample(range(60), 16)) for _ in range(12)]
    sets = [frozenset(list(b)[: 16 - k] + [100 + 20 * n + j for j in range(k)]) for n, b in enumerate(base) for k in (0, 1, 1, 2)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert union_find(len(sets), substring_dedup.similar_pairs(sets)) == union_find(len(sets), links)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        docs = common.cut(out, "stage")
    rows = docs.toPandas()
    assert len(rows) and rows.groupby("sequence_id").length.sum().max() <= 2048
    assert len(corpus_pipeline.run(spark, small).toPandas()) == len(rows)


def test_exact_copies_leave_one_text_each(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = exact_dedup.drop_exact_copies(docs).collect()
    t = texts(spark, small)
    lower = lambda x: x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert sorted(lower(r.text) for r in left) == sorted({lower(x) for x in t.values()})
