"""What the operators share: the shared scratch folder, lineage cuts, and exact rank selection.

Words are runs of ``[^\\x20\\x09-\\x0D]``. ``bytes.split()`` splits on exactly these six
characters and ``bytes.lower()`` changes A-Z only, so the Python sides use those.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: The same six characters as a string, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows of a narrow table that may be broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Smallest and largest long.
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is absent a local session (tests) gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    folder = spark.conf.get("spark.wavemill.scratch", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="wavemill-")
        spark.conf.set("spark.wavemill.scratch", folder)
    return folder


#: Folders of the tables made by ``cut`` in this process.
_made: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: ends its lineage, survives lost executors.

    The table goes when the driver ends, or before by ``drop_cut`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when it ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rsplit("/", 1)[0])


@contextlib.contextmanager
def release(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``cut`` made inside, whose readers must be done by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            remove(spark, path)
        del _made[before:]


def words_count(text: Column) -> Column:
    """Number of words, null and empty texts having none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def rank_threshold(df: DataFrame, key: str, k: int, bits: int = 12) -> int | None:
    """The k-th smallest (1-based) of the long column ``key``, found exactly by narrowing counts.

    Each round counts the rows in at most 2**bits equal parts of the interval that still holds the answer
    and keeps one part, so the driver gets at most 2**bits counts a round and 64/bits rounds suffice.
    None when there are fewer than k rows or k < 1.
    """
    if k < 1:
        return None
    low, shift, left = LONG_MIN, 64 - bits, k
    first = True
    while True:
        rows = df if first else df.where(F.col(key).between(low, low + (1 << (shift + bits)) - 1))
        part = F.shiftright(F.col(key), shift) if shift else F.col(key)
        counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where("part is not null").collect())
        for at, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None
        low = at << shift
        if shift == 0:
            return low
        first, shift, bits = False, max(0, shift - bits), min(bits, shift)


def sized(narrow: DataFrame) -> DataFrame:
    """A written table of a few short columns, marked for broadcast only if its count is within the bound."""
    return F.broadcast(narrow) if narrow.count() <= MOST_BROADCAST else narrow


def spread(docs: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt to all of them before work on each row; others as they are."""
    cores, files = docs.sparkSession.sparkContext.defaultParallelism, len(docs.inputFiles())
    return docs.repartition(cores) if 0 < files < cores and docs.count() <= MOST_BROADCAST else docs


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1,000 at a time, unless the session says otherwise: a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def give_back() -> None:
    """Have this process give the memory it has freed back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(work: Iterator) -> Iterator:
    """``work``, after which a Python worker gives the memory it has freed back to the machine.

    Workers live on between tasks beside the executor's heap.
    """
    try:
        yield from work
    finally:
        give_back()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have in any spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
