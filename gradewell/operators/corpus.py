"""Shaping of downloaded tables into datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradewell.functions.text import map_label


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the given order (each task keeps only its own first n)."""
    return df.orderBy(*order).limit(n)


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """K4: the first n rows of every group; each task passes on at most n rows per group."""
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def union_splits(*splits: DataFrame) -> DataFrame:
    """K5: all rows of all splits, columns matched by name."""
    return reduce(DataFrame.unionByName, splits)


def prepare_corpus(
    splits: Sequence[DataFrame],
    rename: Mapping[str, str],
    keep: Mapping[str, Sequence[str]] | None = None,
    labels: Mapping[str, str] | None = None,
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Join splits, keep rows by value, select and rename columns, map labels, take the first rows.

    ``rename`` maps kept columns to their new names; ``keep`` maps columns to accepted values.
    """
    rows = union_splits(*splits)
    for column, values in (keep or {}).items():
        rows = rows.filter(F.col(column).isin(list(values)))
    if limit is not None:
        rows = first_rows(rows, order, limit)
    out = rows.select(*[F.col(old).alias(new) for old, new in rename.items()])
    return out.withColumn("label", map_label("label", labels)) if labels else out
