"""Joins and numbering that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.session import scratch_root

# A key is hot if it alone holds more than this part of one task's fair share of the rows; below some thousand rows a
# key is no burden for one task whatever its share.
FAIR_PART = 0.5
HOT_ROWS = 10_000
# Lookup tables up to this measured size are broadcast.
BROADCAST_BYTES = 32 << 20


def _hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in on])


def hot_keys(df: DataFrame, on: Sequence[str], share: float | None = None, rows: int | None = None) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of all rows and at least ``rows`` (``HOT_ROWS``) rows.

    Without a ``share`` the limit follows from the number of shuffle partitions: ``FAIR_PART`` of a fair share. One pass over the key columns with a sketch of the most frequent keys: its size is fixed, nothing is shuffled
    by key, and at most 1 / share numbers reach the driver. The sketch only decides which keys are salted; no
    result depends on it.
    """
    if share is None:
        share = min(0.5, FAIR_PART / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most, rows = min(int(1 / share), 100_000), HOT_ROWS if rows is None else rows
    found = df.select(_hash(on).alias("h")).selectExpr("count(*) n", f"approx_top_k(h, {most}, {min(10 * most, 1_000_000)}) top").first()
    return [item["item"] for item in found["top"] if item["count"] >= max(share * found["n"], rows)]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    hot: Sequence[int] | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Left, inner, semi or anti join in which rows of a hot key go to many tasks.

    Left rows of a hot key get a salt from the ``spread`` columns; only the right rows of hot keys
    are repeated once per salt. ``right`` should hold one row per key (aggregate it first).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps left rows; {how!r} does not")
    hot = hot_keys(left, on) if hot is None else list(hot)
    if not hot:
        return left.join(right, list(on), how)
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = list(spread or left.columns)
    is_hot = F.coalesce(_hash(on).isin(hot), F.lit(False))
    salted_left = left.withColumn(
        "_salt",
        F.when(is_hot, F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts))).otherwise(F.lit(0)),
    )
    all_salts = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    salted_right = right.withColumn(
        "_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0).cast("long"))))
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def byte_size(df: DataFrame) -> int:
    """Text bytes of all cells, and 16 more per cell for the table's own bookkeeping."""
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns]
    total = df.select(reduce(lambda a, b: a + b, cells).cast("long").alias("n")).agg(F.sum("n")).first()[0]
    return int(total or 0)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Join a large table with a table of one row per key.

    The lookup is checkpointed and measured. Up to ``BROADCAST_BYTES`` it is broadcast, and the large table is not
    shuffled at all; beyond that the join is salted (:func:`salted_join`).
    """
    scratch_root(left.sparkSession)
    lookup = lookup.checkpoint()
    if byte_size(lookup) <= BROADCAST_BYTES:
        return left.join(F.broadcast(lookup), list(on), how)
    return salted_join(left, lookup, on, how, spread, hot)


def number_rows(
    df: DataFrame, order: Sequence[str], name: str = "position", start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Consecutive numbers over the whole table in the order of ``order``, without a one-task window.

    The rows are range-partitioned by the full order (a hot leading column is split by the later ones)
    and checkpointed, which fixes the partitions. Each row's number is its place in its partition plus the
    number of rows in earlier partitions; the table of those offsets has one row per partition.
    """
    spark = df.sparkSession
    scratch_root(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_place", 33)
    sizes = {r["_part"]: r["_n"] for r in ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()}
    offsets, total = [], start
    for index in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(index, 0)
    offset = F.array(*[F.lit(n).cast("long") for n in offsets])[part.cast("int")]
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, place + offset).drop("_place")


def group_total(df: DataFrame, by: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """Add the total of ``value`` over the groups ``by``.

    Totals come from a combining aggregate and are joined back, because a window would collect a whole
    group into one task. The totals table is small, so the adaptive planner broadcasts it after
    measuring it; should it be large, the same join runs as a shuffle.
    """
    totals = df.groupBy(*by).agg(F.sum(value).alias(name))
    return df.join(totals, list(by), "left")
