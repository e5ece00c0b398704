"""Small helpers that every corpus operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of the whitespace rule, and the word pattern itself.
SPACES = " \t\n\x0b\x0c\r"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the letter-and-digit rule: ASCII letters, digits and everything beyond ASCII.
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between such words (after lower-casing).
LETTER_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 byte tables: bytes beyond ASCII only occur inside words, so one table per rule is enough.
LETTER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased letter-and-digit words of UTF-8 bytes (null: none)."""
    return text.translate(LETTER_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased whitespace words of UTF-8 bytes (null: none)."""
    return text.translate(SPACE_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_text(text: Column) -> Column:
    """Lower case for telling ASCII words apart, much faster on whole texts than ``lower_ascii``.

    Beyond ASCII other letters are lowered as well, which neither joins nor cuts words; only
    the Kelvin sign would become an ASCII letter, so texts with it go the exact way.
    """
    return F.when(F.contains(text, F.lit("\u212a")), lower_ascii(text)).otherwise(F.lower(text))


def among(word: Column, words: list[str], slots: int = 1024) -> Column:
    """Whether the word is one of many: a table of checksums first, as a list is compared entry by entry."""
    taken = {zlib.crc32(w.encode()) % slots for w in words}
    table_ = F.expr("array(" + ",".join(str(k in taken).lower() for k in range(slots)) + ")")
    return F.get(table_, F.pmod(F.crc32(word.cast("binary")), F.lit(slots)).cast("int")) & word.isin(*words)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + (folder := os.path.join(tempfile.gettempdir(), f"quire-{os.getpid()}"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: the plan behind it is cut and survives lost executors."""
    spark = df.sparkSession
    at = work_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: survives lost executors, compressed, read by column."""
    df.write.parquet(at := scratch(df.sparkSession, name))
    return df.sparkSession.read.parquet(at)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs that run meanwhile hand their rows to Python in batches of some ``size`` bytes.

    Spark's own 64 MB are held several times over: by each task's writer, and in Python as a
    batch and as objects.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_hash(*columns: Column) -> Column:
    """A uniform 63-bit hash of a row (the leading 60 bits of an MD5), the tie-break order of the operators."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long") * 8


def bucket_bits(n_rows: Column, bucket_rows: int = 48) -> Column:
    """Leading hash bits that cut so many rows into buckets of about ``bucket_rows``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n_rows, F.lit(1)) / bucket_rows))).cast("int")


def prefix_sums(df: DataFrame, group: str, order: str, value: str, bits: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that stand earlier by ``order``.

    ``order`` holds uniform 63-bit hashes, ``group`` has no nulls. No group is gathered in
    one task: rows fall into buckets by the leading ``bits`` (a column, equal within a
    group) of their hash, buckets into blocks of 1,024, and the three levels are summed
    one after the other. Rows with equal hashes come in the order of their other columns,
    so repeated rows get their places in any order, which cannot be told apart.
    """
    rest = [c for c in df.columns if c not in (order, group, bits)]
    df = df.withColumn("_ps_bucket", F.expr(f"shiftright(`{order}`, 63 - `{bits}`)"))
    up_to = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = df.groupBy(group, "_ps_bucket").agg(F.sum(value).alias("_sum"), F.first(bits).alias("_bits")).withColumn("_block", F.expr("shiftright(_ps_bucket, least(10, _bits))"))
    blocks = sums.groupBy(group, "_block").agg(F.sum("_sum").alias("_sum")).select(group, "_block", before("_sum", up_to([group], ["_block"])).alias("_blocks_before"))
    sums = sums.join(blocks, [group, "_block"]).select(group, "_ps_bucket", (before("_sum", up_to([group, "_block"], ["_ps_bucket"])) + F.col("_blocks_before")).alias("_ps_before"))
    df = df.withColumn("_ps_in", before(value, up_to([group, "_ps_bucket"], [order, *rest])))
    return df.join(sums, [group, "_ps_bucket"]).withColumn(out, F.col("_ps_in") + F.col("_ps_before")).drop("_ps_in", "_ps_before", "_ps_bucket")
