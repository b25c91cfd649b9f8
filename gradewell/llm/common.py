"""Helpers that several operators share: hand-over tables, held-out folds, table reading, partition counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.session import scratch_path, ship_package

# A word: a run of lower-case ASCII letters, digits and everything beyond ASCII. Said in the positive and without
# backtracking, which Java's matcher does three times as fast as the negated class.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
# The same runs in a text that is not lower-cased yet.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in this block go when their query ends, and not when the driver finds them unused."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hand_over(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Later jobs start from the written files, so a lost executor never repeats what came before, and values that
    depend on the order of a scan are fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def let_go(table: DataFrame) -> None:
    """Delete a table of :func:`hand_over` that no later query reads, so that it does not stand on disk beside those that follow."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other letters take the quick built-in."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, amount: int, per_partition: int) -> int:
    """Enough partitions that none has more than about ``per_partition``, and at least the session's own count."""
    return max(shuffle_partitions(spark), -(-int(amount or 0) // per_partition), 1)


def on_table(operator: Callable[[DataFrame], DataFrame], table: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    """The registered form of an operator on one table."""
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))
