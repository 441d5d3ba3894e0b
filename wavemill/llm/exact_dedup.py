"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only).

Each input partition sorts its digests into a run with one entry a digest (a partial sort aggregate).
Runs are then merged in rounds: ``fan_in`` neighbouring runs meet at one run id, their sorted
entries are merged and for each digest the best id so far, the row count and two check values
survive. The last round merges all. A text with a third of all rows is one entry a run already before the
first exchange, so no round sees a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, lower_ascii, sized, table


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row a document: doc_id, digest (SHA-256 of the normalised text), length and second hash."""
    text = lower_ascii(F.col("text"))
    return docs.select("doc_id", text.alias("_t")).select(
        "doc_id", F.unhex(F.sha2("_t", 256)).alias("digest"), F.octet_length("_t").cast("long").alias("length"), F.xxhash64("_t").alias("check")
    )


def merge_runs(rows: DataFrame, fan_in: int = 16, rounds: int = 2, keep: str = "max") -> DataFrame:
    """digest, keep_id, group_size of each distinct text.

    ``keep``: which identifier survives, "min" or "max"; null ids lose against any other. Entries are merged only
    where the digest agrees, and the run fails if entries of one digest differ in length or second hash.
    """
    # A struct keeps these sort aggregates: entries stay in digest order on both sides of every exchange.
    best = F.max if keep == "max" else F.min
    run = F.spark_partition_id()
    level = rows.select(
        run.alias("run"), "digest", F.struct(F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull(), F.col("doc_id").alias("id")).alias("best"),
        F.lit(1).cast("long").alias("n"), F.struct("length", "check").alias("low"), F.struct("length", "check").alias("high"),
    )
    for k in range(rounds + 1):
        by = ["digest"] if k == rounds else ["run", "digest"]
        if k < rounds:
            level = level.withColumn("run", (F.col("run") / fan_in).cast("int"))
        level = level.groupBy(*by).agg(best("best").alias("best"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    same = F.assert_true(F.col("low") == F.col("high"), F.lit("two texts share a SHA-256 digest"))
    return level.select("digest", F.when(same.isNull(), F.col("best.id")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "max", fan_in: int = 16, rounds: int = 2) -> DataFrame:
    """Report on every row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are one group. Rows with the same doc_id and the same text are one
    document: each is returned and all carry the same mark. A null doc_id is kept only where its group has no other
    id. Empty input gives no rows; other columns of ``docs`` are not read.
    """
    rows = cut(digests(docs), "digests")
    groups = cut(merge_runs(rows, fan_in, rounds, keep).where("group_size > 1").select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), "group_size"), "copies")
    # Only texts that occur more than once are joined; a hot text makes a skewed join, which adaptive execution splits.
    joined = rows.join(groups, rows["digest"] == groups["d"], "left")
    keep_id = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("k"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each text, all columns unchanged. Rows repeated with id and text shrink to one too."""
    digest, d, k, n = fresh(docs, "__digest", "__d", "__k", "__n")
    rows = cut(digests(docs.select("doc_id", "text")), "digests")
    groups = cut(merge_runs(rows, keep=keep).where("group_size > 1").select(F.col("digest").alias(d), F.col("keep_id").alias(k)), "copies")
    match, stays = F.col(digest) == F.col(d), F.col(d).isNull() | F.col("doc_id").eqNullSafe(F.col(k))
    narrow = rows.withColumnRenamed("digest", digest).join(sized(groups), match)
    repeats = narrow.where(stays).groupBy(digest).agg(F.count(F.lit(1)).alias("many")).where("many > 1").limit(1).count()
    joined = docs.withColumn(digest, F.unhex(F.sha2(lower_ascii(F.col("text")), 256))).join(sized(groups), match, "left").where(stays)
    if not repeats:
        return joined.select(docs.columns)
    # The id that stays occurs in several rows of one text: these alone are numbered, a few rows a digest.
    first = F.row_number().over(Window.partitionBy(digest).orderBy("doc_id"))
    once = joined.where(F.col(d).isNotNull()).withColumn(n, first).where(F.col(n) == 1)
    return joined.where(F.col(d).isNull()).select(docs.columns).unionByName(once.select(docs.columns))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole table; nulls, empty texts, ties and repeated rows as in ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
"""
