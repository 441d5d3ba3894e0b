"""Fill-in-middle transformation by an escaped marker.

A delimiter that no text holds any more after escaping is put behind every unit of a text by one ``regexp_replace``. The
number of delimiters is the number of units, ``substring_index`` takes the units before, between and after two ranks, and
the parts lose their delimiters and escapes before they are put together. All of it is built-in string functions in one
pass, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The delimiter, and the character that starts an escape: E1 stands for the delimiter, E2 for the escape character.
MARK, ESCAPE = "\x01", "\x02"
#: A unit: a run of letters, an escape, any other code point.
UNIT = r"[A-Za-z]++|\x02[12]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def draws(seed: int, i: str) -> list[Column]:
    """Four unsigned integers from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(i).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def parts(docs: DataFrame, seed: int = 1, moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix: a text's units cut at two drawn ranks.

    ``moved`` percent of the texts are transformed, ``suffix_first`` percent of these in form spm, the others psm. The parts
    are null where the form is plain. Rows as in ``fill_in_middle``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(seed, "doc_id"), 1)))
    taken = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(taken | (F.col("h3") % 100 >= moved), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + MARK))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace(F.col("marked"), F.lit(MARK), F.lit("")))).cast("long"))
    a, b = (f(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int") for f in (F.least, F.greatest))
    rows = rows.withColumn("a", a).withColumn("b", b)
    cut = lambda sql: F.when(F.col("form") != "plain", unescaped(F.expr(sql)))
    return rows.select(
        "doc_id", "text", "n", "form",
        cut(r"substring_index(marked, '\u0001', a)").alias("prefix"),
        cut(r"substring_index(substring_index(marked, '\u0001', b), '\u0001', a - b)").alias("middle"),
        cut(r"substring_index(marked, '\u0001', cast(b - n - 1 as int))").alias("suffix"),  # a delimiter ends the last unit
    )


def assembled(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form alone: no part holds a marker, so each is found at once."""
    p, s = len(PREFIX) + 1, len(SUFFIX) + 1
    front, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring(F.substring_index(front, SUFFIX, 1), p, 2**31 - 1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring(F.substring_index(front, PREFIX, 1), s, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    Null and empty texts and texts that hold a marker stay plain, with null lengths. Texts of any length are cut whole. Draws
    depend on doc_id alone: repeated rows come back repeated and alike, a null doc_id draws as an empty one. Equal ranks
    give an empty middle. Other columns are not read; empty input gives no rows.
    """
    rows = parts(docs, seed, moved, suffix_first)
    out = assembled(*(F.col(c) for c in ("form", "text", "prefix", "middle", "suffix")))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), out.alias("output"))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts, markers and repeated rows as in ``fill_in_middle``."""
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as us, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
    ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from d),
c as (select doc_id, t, us, len(us)::bigint as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1))::bigint as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1))::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
    sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) as output_sha256,
    sha256(t) as restored_sha256 from p
"""
