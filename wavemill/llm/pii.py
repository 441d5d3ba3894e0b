"""Personal data by candidate gradient boosting (DataFrame operations only).

Base patterns give spans that always stay. High-recall generators propose more, overlapping spans: obfuscated mail
addresses, numbers in other formats. Cards and network addresses among them must pass the check of their kind. Boosted
trees score each by its format and what stands before it; a threshold a kind, calibrated on held-out examples,
selects. All of this is one expression over a text, with the trees written out as CASE expressions: no join, no
shuffle, no row leaves its place. Work is in proportion to a text's length: places are sums by blocks, overlaps are
looked for among neighbours in sorted order.

No table labels personal data. The trees learn from a bounded sample of the corpus itself: base matches that pass their
check, written in other ways, speak for; those that fail it, and proposals where no base span is, speak against, each with
the words that stand before it there. The check's outcome is the label and no feature. A fixed number of examples made
by rule is added, since a corpus may lack a kind.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, spread, table

KINDS = ["email", "ip", "card", "phone"]
#: Documents sampled for examples, examples of each kind and label from them and made by rule at most, boosting rounds, depth, and the
#: precision that a threshold must reach.
SAMPLE, MINED, EXAMPLES, ROUNDS, DEPTH, PRECISION = 20_000, 1000, 3000, 12, 3, 0.8
#: Share of wrong candidates that pass the check of their kind by chance: none for addresses, one in ten for a check digit.
BY_CHANCE = [1.0, 0.0, 0.1, 1.0]
#: Elements of an array that are summed one by one, and neighbours on each side that candidates are compared with.
BLOCK, NEIGHBOURS = 64, 32

# The base patterns match what the plain ones match, leftmost first, but never try a start inside a run that failed.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must match before a pattern is tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_AT, _DOT = r"(?: ?[\[(] ?(?i:at) ?[\])] ?| (?i:at) )", r"(?: ?[\[(] ?(?i:dot) ?[\])] ?| (?i:dot) )"
GENERATORS = [
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++", r"(?i)[\[( ]at[\]) ]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?[.,:] ?[0-9]{1,3}){3}(?![0-9.])", r"[0-9] ?[.,:] ?[0-9]"),
    ("card", r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{0,2}[0-9]{2,6}){2,5}(?![0-9])", r"[0-9]{3}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,3}\)?[ ./-]{1,2})[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|[ ./-][0-9]{4}(?![0-9]))", r"[0-9][ ).-]"),
    ("phone", r"(?<![0-9A-Za-z+])00[1-9](?:[ ().-]{0,2}[0-9]){8,13}(?![0-9])", "00[1-9]"),
]
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)\W*(?:\w+\W+){0,1}$",
    "ip": r"(?i)(?:\bip|host|server|address|gateway|ping|login)\W*(?:\w+\W+){0,1}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pan)\W*(?:\w+\W+){0,1}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|contact)\W*(?:\w+\W+){0,1}$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|id|no|number|page|section|ref|license)\W*$"
FEATURES = ["kind", "size", "digits", "separators", "kinds_of", "brackets", "spaces", "letters", "context", "against", "joined"]


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


SPAN = "array<struct<s:int,k:int,e:int,x:string,l:string>>"


def before(values: str, init: str, merge: str) -> str:
    """SQL for the running ``merge`` (of a and x) of all values before each one: by blocks, then inside each block."""
    fold = f"{init}, (a, x) -> {merge}"
    own = let(
        f"transform(sequence(0, cast((size(pa) - 1) div {BLOCK} as int)), c -> aggregate(slice(pa, c * {BLOCK} + 1, {BLOCK}), {fold}))", "pc",
        let(f"transform(pc, (v, c) -> aggregate(slice(pc, 1, c), {fold}))", "pb",
            f"transform(pa, (v, i) -> {let('pb[cast(i div ' + str(BLOCK) + ' as int)]', 'x', let(f'aggregate(slice(pa, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), {fold})', 'a', merge))})"),
    )
    return let(values, "pa", f"case when size(pa) = 0 then pa else {own} end")


def found(text: str, kind: str, pattern: str, hint: str) -> str:
    """Spans of a pattern: its matches, placed by the lengths of the matches and gaps before them, and what stands before each."""
    k = KINDS.index(kind)
    left = "right(concat(case when i > 0 then m[i - 1] else '' end, g[i]), 32)"
    span = let("st[i] + length(g[i])", "b", f"named_struct('s', b, 'k', {k}, 'e', b + length(y), 'x', y, 'l', {left})")
    starts = before("transform(m, (y, i) -> length(g[i]) + length(y))", "0", "a + x")
    placed = let(f"split({text}, {lit(pattern)}, -1)", "g", let(starts, "st", f"transform(m, (y, i) -> {span})"))
    some = let(f"regexp_extract_all({text}, {lit(pattern)}, 0)", "m", f"case when size(m) = 0 then cast(array() as {SPAN}) else {placed} end")
    return f"case when {text} rlike {lit(hint)} then {some} else cast(array() as {SPAN}) end"


def clear(spans: str, blockers: str) -> str:
    """Those of ``spans`` that overlap none of ``blockers``, sorted."""
    entry = "named_struct('s', y.s, 'c', {c}, 'e', y.e, 'y', {y})"
    both = f"array_sort(concat(transform(bl, y -> {entry.format(c=0, y='cast(null as struct<s:int,k:int,e:int,x:string,l:string,m:double>)')}), transform(sp, y -> {entry.format(c=1, y='y')})))"
    last = before("transform(al, y -> case when y.c = 0 then y.e else 0 end)", "0", "greatest(a, x)")
    first = before("transform(reverse(al), y -> case when y.c = 0 then y.s else 2147483647 end)", "2147483647", "least(a, x)")
    kept = "transform(filter(al, (y, i) -> y.c = 1 and la[i] <= y.s and fi[size(al) - 1 - i] >= y.e), y -> y.y)"
    return let(spans, "sp", let(blockers, "bl", f"case when size(sp) = 0 then sp else {let(both, 'al', let(last, 'la', let(first, 'fi', kept)))} end"))


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


#: Luhn sum modulo 10 of the digits d.
LUHN = "aggregate(sequence(1, greatest(1, length(d))), 0, (a, i) -> a + " + let("coalesce(cast(substring(d, -i, 1) as int), 0)", "v", "case when i % 2 = 1 then v when v > 4 then 2 * v - 9 else 2 * v end") + ", a -> a % 10)"
PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}$"


def valid(x: str) -> str:
    """Whether a base match of kind x.k counts."""
    card = let(digits(f"{x}.x"), "d", f"case when length(d) between 12 and 19 then {LUHN} = 0 else false end")
    return f"case {x}.k when 0 then true when 1 then {x}.x rlike {lit(PARTS)} when 2 then {card} else length({digits(f'{x}.x')}) between 9 and 15 end"


def checked(x: str) -> str:
    """Whether a candidate of kind x.k passes the check of its kind; addresses and phone numbers have none."""
    card = let(digits(f"{x}.x"), "d", f"case when length(d) between 12 and 19 then {LUHN} = 0 else false end")
    plain = f"regexp_replace({x}.x, '[ ,:]+', '.')"
    return f"case {x}.k when 1 then {plain} rlike {lit(PARTS)} when 2 then {card} else true end"


def features(kind: str, x: str, left: str) -> str:
    """Numbers that describe a candidate ``x`` of kind number ``kind`` with the text ``left`` before it."""
    context = f"case {kind} " + " ".join(f"when {k} then {left} rlike {lit(CONTEXT[name])}" for k, name in enumerate(KINDS)) + " end"
    seps = f"regexp_replace({x}, '[A-Za-z0-9]', '')"
    return "named_struct(" + ", ".join((
        f"'kind', cast({kind} as double)", f"'size', cast(length({x}) as double)", f"'digits', cast(length({digits(x)}) as double)",
        f"'separators', cast(length({seps}) as double)", f"'kinds_of', cast(size(array_distinct(split({seps}, ''))) as double)",
        f"'brackets', case when {x} rlike {lit('[(' + chr(92) + '[]')} then 1D else 0D end", f"'spaces', cast(length({x}) - length(replace({x}, ' ', '')) as double)",
        f"'letters', cast(length(regexp_replace({x}, '[^A-Za-z]', '')) as double)", f"'context', case when {context} then 1D else 0D end",
        f"'against', case when {left} rlike {lit(AGAINST)} then 1D else 0D end", f"'joined', case when {left} rlike {lit('[A-Za-z0-9]$')} then 1D else 0D end",
    )) + ")"


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """kind (number), x, left, label, fold: ``n`` examples made by rule; the same ones each time."""

    def number(salt: int, low: int, high: int) -> str:
        return f"cast({low} + pmod(xxhash64(id, {salt}), {high - low + 1}) as string)"

    def pick(salt: int, *of: str) -> str:
        return f"element_at(array({', '.join(map(lit, of))}), 1 + cast(pmod(xxhash64(id, {salt}), {len(of)}) as int))"

    word = pick(1, "anna", "info", "j.smith", "office", "the", "sales", "m-lee", "team")
    host = pick(2, "example", "mail", "corp", "uni", "post", "shop")
    top = pick(3, "com", "org", "net", "de", "fr", "es")
    at = pick(4, " at ", " [at] ", "[at]", " (at) ", "(at)")
    dot = pick(5, " dot ", " [dot] ", "[dot]", "(dot)")
    common = pick(6, "and", "of", "was", "is", "one", "much")
    d15 = f"concat({number(7, 4000, 5999)}, {number(8, 1000, 9999)}, {number(9, 1000, 9999)}, {number(10, 100, 999)})"
    sums = let(f"concat({d15}, '0')", "d", LUHN)
    good = f"concat({d15}, cast(pmod(10 - {sums}, 10) as string))"
    bad = f"concat({d15}, cast(pmod(11 + cast(pmod(xxhash64(id, 11), 8) as int) - {sums}, 10) as string))"
    sep = pick(12, "", "", " ", "-", ".", "/")

    def grouped(x: str) -> str:
        return let(x, "q", f"concat_ws({sep}, substring(q, 1, 4), substring(q, 5, 4), substring(q, 9, 4), substring(q, 13, 4))")

    octet = [number(20 + k, 1, 255) for k in range(4)]
    over = [f"case when pmod(xxhash64(id, 29), 4) = {k} then {number(30 + k, 256, 999)} else {octet[k]} end" for k in range(4)]
    dots = pick(13, ".", " . ", ",", ":")
    abc = (number(14, 200, 989), number(15, 200, 999), number(16, 1000, 9999))
    forms = [
        (0, 1, f"concat({word}, {at}, {host}, {dot}, {top})"), (0, 1, f"concat({word}, {pick(4, ' [at] ', '[at]', '(at)')}, {host}, '.', {top})"),
        (0, 0, f"concat({common}, ' at ', {pick(2, 'home', 'noon', 'work', 'night')}, '.', {pick(3, 'The', 'And', 'It', 'So')})"),
        (1, 1, f"concat_ws({dots}, {', '.join(octet)})"), (1, 0, f"concat_ws({dots}, {', '.join(over)})"),
        (2, 1, grouped(good)), (2, 0, grouped(bad)), (2, 0, f"concat({number(17, 1990, 2030)}, '-', {number(18, 10, 12)}, '-', {number(19, 10, 28)})"),
        (3, 1, f"concat('(', {abc[0]}, ') ', {abc[1]}, '-', {abc[2]})"), (3, 1, f"concat({abc[0]}, {pick(40, '-', '.', ' ')}, {abc[1]}, '-', {abc[2]})"),
        (3, 1, f"concat('00', {number(41, 1, 9)}, ' ', {abc[0]}, ' ', {abc[1]}, ' ', {abc[2]})"), (3, 0, f"concat({number(42, 10, 99)}, '.', {abc[1]}, '.', {number(43, 100, 999)})"),
    ]
    part = f"cast(pmod(xxhash64(id, 44), {len(forms)}) as int)"
    rows = spark.range(n).selectExpr("id", f"{part} as f")
    case = "case f " + " ".join(f"when {k} then {x}" for k, (_, _, x) in enumerate(forms)) + " end"
    kind = "case f " + " ".join(f"when {k} then {a}" for k, (a, _, _) in enumerate(forms)) + " end"
    label = "case f " + " ".join(f"when {k} then {a}" for k, (_, a, _) in enumerate(forms)) + " end"
    telling = f"case {kind} when 0 then {pick(45, 'contact ', 'email: ', 'write to ')} when 1 then {pick(46, 'host ', 'server ', 'ip ')} when 2 then {pick(47, 'card ', 'visa ', 'credit card ')} else {pick(48, 'call ', 'phone: ', 'tel ')} end"
    plain = pick(49, "the ", "and then ", "with ", "it was ", "version ", "order ", "page ")
    left = f"case when pmod(xxhash64(id, 50), 3) = {label} then {telling} else {plain} end"
    return rows.selectExpr(f"{kind} as kind", f"{case} as x", f"{left} as left", f"cast({label} as double) as label", "cast(pmod(xxhash64(id, 51), 4) as int) as fold")


def spans_of(text: str) -> str:
    """All base matches of a text, whether or not they pass their check."""
    return "concat(" + ", ".join(found(text, k, BASE[k], HINT[k]) for k in KINDS) + ")"


def proposals(text: str) -> str:
    return "concat(" + ", ".join(found(text, k, p, h) for k, p, h in GENERATORS) + ")"


def mined(docs: DataFrame, sample: int = SAMPLE, most: int = MINED) -> DataFrame:
    """kind, x, left, label, fold from about ``sample`` documents, taken by a hash of their id; ``most`` of a kind and label.

    A base match is written as the generators would meet it: an address with its signs spelt out, digits in groups
    with other separators, a phone number without its plus.
    """
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(77)), 11) / F.lit(float(1 << 53)) < share).select(F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.where(" or ".join(f"_t rlike {lit(h)}" for h in sorted({*HINT.values(), *(h for _, _, h in GENERATORS)})))
    rows = rows.selectExpr(f"transform({spans_of('_t')}, y -> named_struct('y', y, 'ok', {valid('y')})) as b", f"{proposals('_t')} as p")
    own = rows.selectExpr("explode(b) as y").selectExpr("y.y.k as kind", "y.y.x as x", "y.y.l as left", "cast(y.ok as double) as label")
    # Where a base match overlaps, passed or failed, the proposal is that match again.
    loose = rows.selectExpr(f"{scored_as('p', '0D')} as p", f"{scored_as('transform(b, y -> y.y)', '0D')} as b").selectExpr(f"explode({clear('p', 'b')}) as y").selectExpr("y.k as kind", "y.x as x", "y.l as left", "0D as label")

    def pick(salt: int, *of: str) -> str:
        return f"element_at(array({', '.join(map(lit, of))}), 1 + cast(pmod(xxhash64(x, left, {salt}), {len(of)}) as int))"

    mail = f"replace(replace(x, '@', {pick(1, ' at ', ' [at] ', '[at]', ' (at) ')}), '.', {pick(2, '.', ' dot ', '[dot]')})"
    quads = let(digits("x"), "q", f"rtrim({pick(4, '.', '-', '/', '_')}, concat_ws({pick(4, '.', '-', '/', '_')}, substring(q, 1, 4), substring(q, 5, 4), substring(q, 9, 4), substring(q, 13)))")
    call = let(digits("x"), "q", f"case when pmod(xxhash64(x, left, 5), 2) = 0 then concat('00', q) else concat_ws({pick(6, '-', '.', ' ')}, substring(q, -10, 3), substring(q, -7, 3), substring(q, -4)) end")
    written = own.withColumn("x", F.expr(f"case kind when 0 then {mail} when 1 then replace(x, '.', {pick(3, ' . ', ',', ':')}) when 2 then {quads} else {call} end"))
    every = written.where("length(x) <= 64").unionByName(loose).distinct().withColumn("h", F.xxhash64("x", "left"))
    every = cut(every, "mined")
    parts = [every.where(f"kind = {k} and label = {y}").orderBy("h", "x", "left").limit(most) for k in range(len(KINDS)) for y in (0, 1)]
    return reduce(DataFrame.unionByName, parts).selectExpr("kind", "x", "left", "label", "cast(pmod(xxhash64(x, left, 9), 4) as int) as fold")


def scored_as(spans: str, margin: str) -> str:
    """Spans with their margin, of candidate ``c``."""
    return f"transform({spans}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'x', c.x, 'l', c.l, 'm', {margin}))"


def tree_sql(node, row: str) -> str:
    """A decision tree's node as nested CASE over the fields of ``row``."""
    if node.numDescendants() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    test = f"{row}.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D"
    return f"case when {test} then {tree_sql(node.leftChild(), row)} else {tree_sql(node.rightChild(), row)} end"


class Model:
    """SQL for the margin of features ``f``, the least margin of each kind, and what they reach on held-out examples."""

    def __init__(self, margin: str, limits: list[float], report: list[dict]):
        self.margin, self.limits, self.report = margin, limits, report


def fit(spark: SparkSession, docs: DataFrame | None = None, n: int = EXAMPLES, precision: float = PRECISION) -> Model:
    """Boosted trees and thresholds from examples of ``docs`` and ``n`` made by rule.

    Three quarters of the examples train. On the rest a threshold is the lowest margin from which on at least
    ``precision`` of what is selected and passes the check of its kind is right, and never below even odds after the check.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    made = examples(spark, n)
    if docs is not None:
        made = made.unionByName(mined(docs))
    rows = made.where("x <> ''").withColumn("f", F.expr(features("kind", "x", "left"))).select("label", "fold", "f")
    flat = cut(rows.select("label", "fold", *(F.col(f"f.{c}").alias(c) for c in FEATURES)).coalesce(1).sortWithinPartitions("label", "fold", *FEATURES), "examples")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=64).fit(data.where("fold > 0").select("label", "features"))
    trees = [tree_sql(t._call_java("rootNode"), "f") for t in model.trees]
    margin = " + ".join(f"{float(w)!r}D * ({t})" for w, t in zip(model.treeWeights, trees, strict=True))
    held = flat.where("fold = 0").withColumn("f", F.struct(*FEATURES)).select(F.col("kind").cast("int").alias("kind"), "label", F.expr(margin).alias("m")).collect()
    limits, report = [], []
    for k, name in enumerate(KINDS):
        own = sorted(((r["m"], r["label"]) for r in held if r["kind"] == k), reverse=True)
        limit, right, wrong = float("inf"), 0.0, 0.0
        reached, even = (1.0, 0.0), 0.5 * math.log(max(BY_CHANCE[k], 1e-3))  # a margin is half the logarithm of the odds
        for at, (m, label) in enumerate(own, 1):
            right, wrong = right + label, wrong + (1 - label) * BY_CHANCE[k]
            if m > even and right >= precision * (right + wrong) and right and (at == len(own) or own[at][0] < m):
                limit, reached = m, (right / (right + wrong), right / max(1.0, sum(x for _, x in own)))
        limits.append(limit)
        report.append({"kind": name, "held_out": len(own), "precision": reached[0], "recall": reached[1]})
    drop_cut(flat)
    return Model(margin, limits, report)


def joined(spans: str) -> str:
    """kind:start:end of sorted spans, comma-joined."""
    names = "array(" + ", ".join(map(lit, KINDS)) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_personal_data(docs: DataFrame, model: Model | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, spans_base and spans_all of every row: arrays of s, k (kind number), e, x, by start, then kind.

    Places are code points, ends exclusive. Null and empty texts have no spans. Nothing but doc_id and text is read;
    repeated rows come back repeated; empty input gives no rows. Base spans may overlap each other across kinds; a
    proposed span is left out where it overlaps a base span, a proposed address, or a proposed number of larger margin
    (of equal margin the first).
    """
    model = model or fit(docs.sparkSession, docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    short = "named_struct('s', x.s, 'k', x.k, 'e', x.e, 'x', x.x)"
    rows = text.selectExpr("doc_id", "_t", f"array_sort(transform(filter({spans_of('_t')}, x -> {valid('x')}), x -> {short})) as _b")
    limit = "case c.k " + " ".join(f"when {k} then {'1e300D' if v == float('inf') else f'{v!r}D'}" for k, v in enumerate(model.limits)) + " end"
    blockers = "transform(_b, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'x', '', 'l', '', 'm', 0D))"
    margin = let(features("c.k", "c.x", "c.l"), "f", model.margin)
    better = f"exists(slice(_ns, greatest(1, i - {NEIGHBOURS - 1}), least(i, {NEIGHBOURS})), o -> c.s < o.e and o.m >= c.m) or exists(slice(_ns, i + 2, {NEIGHBOURS}), o -> o.s < c.e and o.m > c.m)"
    hints = " or ".join(f"_t rlike {lit(h)}" for h in sorted({h for _, _, h in GENERATORS}))
    # Step by step: one expression would nest deeper than the analyzer goes.
    rows = rows.withColumn("_c", F.expr(f"case when {hints} then {scored_as(proposals('_t'), '0D')} else {scored_as(f'cast(array() as {SPAN})', '0D')} end"))
    rows = rows.withColumn("_c", F.expr(clear("_c", blockers)))
    rows = rows.withColumn("_c", F.expr(f"filter({scored_as(f'filter(_c, c -> {checked("c")})', margin)}, c -> c.m >= {limit})"))
    rows = rows.withColumn("_ns", F.expr(clear("filter(_c, c -> c.k > 0)", "filter(_c, c -> c.k = 0)")))
    best = f"concat(filter(_c, c -> c.k = 0), filter(_ns, (c, i) -> not ({better})))"
    return rows.selectExpr("doc_id", *(["_t as text"] if keep_text else []), "_b as spans_base", f"case when size(_c) = 0 then _b else array_sort(concat(_b, transform({best}, x -> {short}))) end as spans_all")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    # The text between two places, cut from the blocks of 1024 that hold it.
    part = "case when {b} <= {a} then '' else substring(array_join(slice(ch, cast({a} div 1024 as int) + 1, cast({b} div 1024 as int) - cast({a} div 1024 as int) + 1), ''), {a} % 1024 + 1, {b} - {a}) end"
    gap = let("pe[i]", "p", f"case when x.s < p then '' else concat({part.format(a='p', b='x.s')}, '<', array('email','ip','card','phone')[x.k], '>') end")
    ends = before("transform(spans_all, x -> x.e)", "0", "greatest(a, x)")
    tail = let("array_max(transform(spans_all, x -> x.e))", "p", part.format(a="p", b="length(text)"))
    rows = find_personal_data(docs, model, keep_text=True).selectExpr("*", "regexp_extract_all(text, '(?s).{1,1024}', 0) as ch", f"{ends} as pe")
    return rows.selectExpr("doc_id", f"case when size(spans_all) = 0 then text else concat(array_join(transform(spans_all, (x, i) -> {gap}), ''), {tail}) end as text")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts, repeated rows and overlaps as in ``find_personal_data``."""
    spans = find_personal_data(spread(table(spark, sf_dir, "documents")))
    counts = [F.expr(f"cast(size(filter(spans_base, x -> x.k = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(F.expr(joined("spans_base")), 256).alias("base_sha256"), F.expr(joined("spans_all")).alias("spans"))
