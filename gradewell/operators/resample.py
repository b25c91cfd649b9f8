"""Means of per-pair scores with intervals from a Poisson bootstrap.

Each replicate gives every pair a Poisson(1) weight that follows from a hash of the pair's key and the replicate, so a lost
task repeats the same weights and all replicates come from one pass: a task multiplies its scores with its weights and hands
on sums, whatever the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLICATES, INTERVAL = 200, 0.95
# Weights are (factor * key + shift) modulo a prime, with powers of two generators of that prime field as factor and shift.
PRIME, GENERATORS = (1 << 31) - 1, (48271, 16807)
# Chances that a Poisson(1) weight is at most 0, 1, 2, ...; the rest is below one in a thousand million.
_CUMULATED = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
THRESHOLDS = [int(c * PRIME) for c in _CUMULATED]


def factors(replicates: int) -> list[tuple[int, int]]:
    return [tuple(pow(g, r, PRIME) for g in GENERATORS) for r in range(1, replicates + 1)]


def key_number(key: Sequence[str]) -> Column:
    """A number below 2**31 from the MD5 of the key columns."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


def weights(numbers: np.ndarray, replicates: int = REPLICATES) -> np.ndarray:
    """Pairs by replicates: how often each pair is drawn."""
    a, b = np.array(factors(replicates), np.int64).T
    drawn = (numbers[:, None].astype(np.int64) * a + b) % PRIME
    return np.searchsorted(THRESHOLDS, drawn.ravel(), side="right").reshape(drawn.shape).astype(np.float64)


def _sums(batches: Iterable[pa.RecordBatch], groups: int, replicates: int) -> Iterator[pa.RecordBatch]:
    """Per group of one task: its sums, plain ones first, then those of every replicate."""
    sums: dict[tuple, np.ndarray] = {}
    types: list[pa.Field] = []
    for batch in batches:
        types = list(batch.schema)[:groups]
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:groups]))) if groups else [()] * batch.num_rows
        codes: dict[tuple, int] = {}
        code = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        numbers = batch.column(groups).to_numpy()
        scores = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[groups + 1 :])], axis=1)
        scores = np.nan_to_num(scores)
        for key, own in codes.items():
            for at in np.array_split(np.flatnonzero(code == own), max(1, (code == own).sum() // 5_000)):
                drawn = np.column_stack([np.ones(len(at)), weights(numbers[at], replicates)])
                sums[key] = sums.get(key, 0) + drawn.T @ scores[at]
    for key, found in sums.items():
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k], f.type) for k, f in zip(key, types)], pa.array([found.ravel().tolist()], pa.list_(pa.float64()))],
            names=[*[f.name for f in types], "sums"])


def resampled_means(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], by: Sequence[str] = ("dataset", "model"),
    replicates: int = REPLICATES, interval: float = INTERVAL,
) -> DataFrame:
    """A26 with intervals: per group, each score's mean, the ``_low``, ``_mid`` and ``_high`` percentiles of its resampled means, and pairs.

    ``key`` identifies a pair. A missing score counts as 0, as an empty text does. A replicate that draws no pair of a small
    group has no mean and is left out.
    """
    narrow = df.select(*by, key_number(key).alias("_number"), *[F.col(c).cast("double").alias(c) for c in columns])
    schema = T.StructType([*[narrow.schema[b] for b in by], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    partial = narrow.mapInArrow(lambda b: _sums(b, len(by), replicates), schema)
    width = len(columns) + 1
    cells = partial.select(*by, F.posexplode("sums").alias("at", "value")).groupBy(*by, "at").agg(F.sum("value").alias("value"))
    cells = cells.withColumn("replicate", F.floor(F.col("at") / width))
    wide = cells.groupBy(*by, "replicate").agg(*[F.max(F.when(F.col("at") % width == i, F.col("value"))).alias(f"s{i}") for i in range(width)])
    means = wide.select(*by, "replicate", "s0", *[F.try_divide(f"s{i + 1}", "s0").alias(c) for i, c in enumerate(columns)])
    points = [(1 - interval) / 2, 0.5, (1 + interval) / 2]
    found = means.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("s0"))).cast("long").alias("pairs"),
        *[F.max(F.when(F.col("replicate") == 0, F.col(c))).alias(c) for c in columns],
        *[F.percentile(F.when(F.col("replicate") > 0, F.col(c)), points).alias(f"_{c}") for c in columns])
    return found.select(
        *by, *[x for c in columns for x in (F.col(c), *[F.col(f"_{c}")[i].alias(f"{c}_{side}") for i, side in enumerate(("low", "mid", "high"))])],
        "pairs")
