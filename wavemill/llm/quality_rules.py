"""Quality rules by distribution divergence (DataFrame operations only).

Base counts of every text, then two Jensen-Shannon distances: of its character classes and of its common
words, each to the reference of its language. That is summed over the texts that pass the base rules, and then
again over those of them near the first sum, so that junk doesn't shift it. Short texts are guarded: they are judged
by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, spread, table

# Common words of four languages, in four groups of falling frequency.
COMMON = {
    "en": [["the", "of"], ["and", "to", "a", "in"], ["is", "that", "it", "for", "was", "on"], ["with", "as", "be", "by", "this", "are", "at", "from"]],
    "de": [["der", "die"], ["und", "in", "den", "von"], ["zu", "das", "mit", "sich", "des", "ein"], ["auf", "für", "ist", "im", "nicht", "dem"]],
    "fr": [["de", "la"], ["le", "et", "les", "des"], ["en", "un", "du", "une", "que", "pour"], ["est", "par", "qui", "dans", "avec", "sur", "pas", "au"]],
    "es": [["de", "la"], ["que", "el", "en", "y"], ["los", "se", "del", "las", "un", "por"], ["con", "no", "su", "una", "para", "es", "al", "lo"]],
}
#: Limits of the two distances (square roots of the divergence in bits), and the least size to be judged.
CHARS_LIMIT, WORDS_LIMIT = 0.19, 0.30
LEAST_CHARS, LEAST_WORDS = 800, 200
#: Languages whose references are broadcast at most, about 200 bytes each.
MOST_BROADCAST = 20_000
#: Character classes, each a Java regular expression: small letters, white space, capitals, digits, symbols,
#: punctuation; what is in none is the last class.
CLASSES = [r"\p{Ll}", f"[{SPACE}]", r"\p{Lu}", r"\p{Nd}", r"[#*$%&|<>]", r"[.,;:!?()'\"-]"]


LETTER = r"\p{L}"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pairs(a: str, step: int) -> str:
    """Digests of each element with the one ``step`` further on; the last ``step`` are of no use."""
    return f"zip_with({a}, slice({a}, {step + 1}, greatest(0, size({a}) - {step})), (x, y) -> xxhash64(x, y))"


#: Words inside 8-word windows that occur twice or more: digests of all windows (of two, four, then eight words) are
#: sorted with their places, places with an equal neighbour are put in order, and each adds the words it covers beyond
#: the one before.
REPEATED = "case when size(w) < 9 then 0L else {} end".format(
    let("transform(w, x -> xxhash64(x))", "h1", let(pairs("h1", 1), "h2", let(pairs("h2", 2), "h4", let(f"slice({pairs('h4', 4)}, 1, size(w) - 7)", "h", "case when size(array_distinct(h)) = size(h) then 0L else {} end".format(
        let("array_sort(transform(h, (x, i) -> struct(x as h, i as i)))", "o",
            let("array_sort(filter(transform(o, (x, k) -> case when (k > 0 and o[k - 1].h = x.h) or (k < size(o) - 1 and o[k + 1].h = x.h) then x.i end), x -> x is not null))", "p",
                "case when size(p) = 1 then 8L else 8L + aggregate(sequence(1, size(p) - 1), 0L, (acc, k) -> acc + least(8, p[k] - p[k - 1])) end")))))))
)


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and two histograms, chars and words, of every text."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("_t"))
    lists = "case lang " + " ".join(f"when {lit(k)} then array({', '.join('array(' + ', '.join(map(lit, g)) + ')' for g in v)})" for k, v in COMMON.items()) + " end"
    lines = let(f"filter(split(_t, '\\n', -1), x -> x rlike {lit(f'[^{SPACE}]')})", "l", "cast(size(l) - size(array_distinct(l)) as bigint)")
    # Only words as short as those in the lists are cut out of the text; all others count as one class.
    short = max(len(w) for v in COMMON.values() for g in v for w in g)
    found = f"regexp_extract_all(lower(_t), {lit(f'(?<!{LETTER}){LETTER}{{1,{short}}}+(?!{LETTER})')}, 0)"
    common = let(lists, "c", "case when c is not null then " + let(found, "u", "transform(c, g -> cast(size(filter(u, x -> array_contains(g, x))) as bigint))") + " end")
    # Each class is taken out of what the ones before have left, so the later passes are over little.
    classes = "array(" + ", ".join(f"cast(length(c{k}) as bigint)" for k in range(7)) + ")"
    for k in reversed(range(6)):
        classes = let(f"regexp_replace({f'c{k}' if k else '_t'}, {lit(CLASSES[k] + '+')}, '')", f"c{k + 1}", classes if k else classes.replace("c0", "_t"))
    words = f"regexp_extract_all(_t, {lit(f'[^{SPACE}]+')}, 0)"
    made = rows.selectExpr(
        "doc_id", "lang", f"{words} as _w", f"{lines} as n_dup_lines", f"{classes} as _k", "_t",
    )
    counted = made.selectExpr(
        "doc_id", "lang", "cast(size(_w) as bigint) as n_words", "_k[0] - (_k[1] - _k[2]) as word_chars", "_k[4] - _k[5] as n_symbols", "n_dup_lines",
        f"{let('_w', 'w', REPEATED)} as n_repeat_words",
        "array(_k[0] - _k[1], _k[1] - _k[2], _k[2] - _k[3], _k[3] - _k[4], _k[4] - _k[5], _k[5] - _k[6], _k[6]) as chars",
        f"{common} as _u",
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    words_hist = F.expr("case when _u is not null then concat(_u, array(greatest(0L, n_words - _u[0] - _u[1] - _u[2] - _u[3]))) end")
    return counted.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "chars", words_hist.alias("words"))


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts, in [0, 1]; null where either has no counts."""
    half = "aggregate(zip_with(transform({a}, x -> x / _sum_a), transform({b}, x -> x / _sum_b), (p, q) -> case when p > 0 then p * log2(2 * p / (p + q)) else 0D end), 0D, (s, x) -> s + x)"

    def term(a: str, b: str) -> str:
        return half.format(a=a, b=b).replace("_sum_a", "sa" if a == counts else "sb").replace("_sum_b", "sb" if a == counts else "sa")

    total = "aggregate({}, 0L, (s, x) -> s + x)"
    body = f"sqrt(greatest(0D, ({term(counts, reference)} + {term(reference, counts)}) / 2))"
    return F.expr(let(f"cast({total.format(counts)} as double)", "sa", let(f"cast({total.format(reference)} as double)", "sb", f"case when sa > 0 and sb > 0 then {body} end")))


def references(rows: DataFrame) -> DataFrame:
    """_lang, ref_chars, ref_words: histograms summed over a language's texts that pass the base rules."""
    sums = [F.sum(F.when(~F.col("base_failed"), F.col(c)[k])).alias(f"{c}{k}") for c, n in (("chars", 7), ("words", 5)) for k in range(n)]
    found = rows.groupBy("lang").agg(*sums)
    return found.select(F.col("lang").alias("_lang"), F.array(*(F.coalesce(f"chars{k}", F.lit(0)) for k in range(7))).alias("ref_chars"), F.array(*(F.coalesce(f"words{k}", F.lit(0)) for k in range(5))).alias("ref_words"))


def measured(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with their distances.

    The references, a row a language, are broadcast if they are few enough; else they are joined by a shuffle.
    """
    refs = cut(refs, "references")
    few = refs.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(refs) if few else refs, F.col("lang") == F.col("_lang"))
    return joined.withColumn("chars_distance", distance("chars", "ref_chars")).withColumn("words_distance", distance("words", "ref_words")).drop("_lang", "ref_chars", "ref_words")


def judge(docs: DataFrame, chars_limit: float = CHARS_LIMIT, words_limit: float = WORDS_LIMIT, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, chars_distance, words_distance of every row.

    Null text has no words and fails the base rules. A null language is a language of its own; one without a
    list of common words, or without texts that pass, is judged by what there is. Distances are null where there
    is nothing to compare. Repeated rows come back repeated; other columns are not read; empty input gives no rows.
    """
    rows = cut(stats(docs), "quality-stats")
    first = measured(rows, references(rows)).where(F.coalesce(F.col("chars_distance") <= chars_limit, F.lit(True)))
    measured_rows = measured(rows, references(first))
    n_chars = F.expr("aggregate(chars, 0L, (s, x) -> s + x)")
    odd = (n_chars >= least_chars) & F.coalesce(F.col("chars_distance") > chars_limit, F.lit(False))
    odd = odd | ((F.col("n_words") >= least_words) & F.coalesce(F.col("words_distance") > words_limit, F.lit(False)))
    return measured_rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "chars_distance", "words_distance")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts and repeated rows as in ``judge``."""
    return judge(spread(table(spark, sf_dir, "documents"))).drop("chars_distance", "words_distance")


def _sql() -> str:
    """The same in DuckDB: windows and histograms as rows instead of arrays."""
    space = r"[^\x20\x09-\x0D]"
    left = "text"
    sizes = ["length(text)"]
    for c in CLASSES:
        left = f"regexp_replace({left}, '{c.replace(chr(39), chr(39) * 2)}+', '', 'g')"
        sizes.append(f"length({left})")
    chars = ", ".join([f"{a} - {b}" for a, b in zip(sizes[:-1], sizes[1:], strict=True)] + [sizes[-1]])
    groups = " union all ".join(f"select '{lang}' as lang, {j} as j, unnest([{', '.join(repr(w) for w in g)}]) as word" for lang, v in COMMON.items() for j, g in enumerate(v))
    short = max(len(w) for v in COMMON.values() for g in v for w in g)

    def distances(name: str, ref: str) -> str:
        p, q = "x / nullif(sp, 0)", "r / nullif(sr, 0)"
        return f"""{name} as (select doc_id, kind, sqrt(greatest(0, (sum(case when x > 0 then {p} * log2(2 * ({p}) / ({p} + {q})) else 0 end) + sum(case when r > 0 then {q} * log2(2 * ({q}) / ({p} + {q})) else 0 end)) / 2)) as d
  from (select h.doc_id, kind, j, x * 1.0 as x, r * 1.0 as r, sum(x) over (partition by doc_id, kind) as sp, sum(r) over (partition by doc_id, kind) as sr from h join {ref} using (lang, kind, j)) where sp > 0 and sr > 0 group by all)"""

    return rf"""
with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{space}+') as w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{space}')) as lines, [{chars}] as c from t),
win as (select doc_id, i, list_slice(w, i, i + 7) as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) > 8)),
rep as (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from rep group by 1),
b as (select w.doc_id, lang, text, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars, cast(c[5] as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n, 0) as bigint) as n_repeat_words, len(w) < 20 or 100 * coalesce(n, 0) > 30 * len(w) as base_failed, c, length(text) as n_chars from w left join cov using (doc_id)),
lists as ({groups}),
u as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from b where lang in (select lang from lists)),
hw as (select b.doc_id, b.lang, b.base_failed, j, count(u.word) as x from b join (select distinct lang, j from lists) g using (lang) left join (u join lists using (lang, word)) u using (doc_id, lang, j) where length(coalesce(u.word, '')) <= {short} group by all),
h as (select doc_id, lang, base_failed, 'c' as kind, unnest(range(7)) as j, unnest(c) as x from b
  union all select doc_id, lang, base_failed, 'w', j, x from hw
  union all select b.doc_id, b.lang, b.base_failed, 'w', 4, greatest(0, any_value(n_words) - sum(x)) from b join hw using (doc_id) group by all),
r1 as (select lang, kind, j, sum(case when base_failed then 0 else x end) as r from h group by all),
{distances("d1", "r1")},
near as (select b.doc_id from b left join d1 on d1.doc_id = b.doc_id and kind = 'c' where coalesce(d <= {CHARS_LIMIT}, true)),
r2 as (select lang, kind, j, sum(case when base_failed then 0 else x end) as r from h semi join near using (doc_id) group by all),
{distances("d2", "r2")}
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_chars >= {LEAST_CHARS} and coalesce(a.d > {CHARS_LIMIT}, false)) and not (n_words >= {LEAST_WORDS} and coalesce(z.d > {WORDS_LIMIT}, false)) as kept
from b left join d2 a on a.doc_id = b.doc_id and a.kind = 'c' left join d2 z on z.doc_id = b.doc_id and z.kind = 'w'
"""


OP8_SQL = _sql()
