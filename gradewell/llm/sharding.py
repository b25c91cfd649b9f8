"""Records dealt to shards of nearly equal bytes by sampled splitters.

Keys are (text hash, id, row number), so equal texts are neighbours and even a group that holds a third of all rows can
be cut; a smaller one stays whole in one shard. A sample of keys, drawn with a probability in proportion to size, gives quantile boundaries of small ranges.
Every record goes to its range; ranges that turn out overfull get boundaries of their own from a sample of just their
keys. The ranges, measured exactly, are dealt to the shards, largest first to the emptiest shard.

The driver holds the sample and one number per range: ``PIECES`` ranges per shard, or one per ``RANGE_ROWS`` rows.
Null text has no bytes, its CRC is that of no bytes. Null ids sort before all others. Repeated rows are rows like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import hand_over

SHARDS, PIECES, RANGE_ROWS = 24, 64, 1_000_000
# Sampled keys per range; a range is overfull beyond so many times the mean; turns of cutting overfull ranges.
SAMPLE, OVERFULL, TURNS = 32, 2.0, 6
EXTRA_BYTES = 8
# A group of equal texts is cut if it holds more than one in so many of a shard's bytes.
GROUP_SHARE = 8


def _key_bytes(hashes: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes that sort like the three signed numbers."""
    flipped = np.stack([hashes, ids, rows], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return flipped.astype(">u8").view("S24").ravel()


def _range_batches(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, i, r = (batch.column(k).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        found = np.searchsorted(shared.value, _key_bytes(h, i, r), side="right")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], names=[*batch.schema.names, "range"])


def _ranged(keyed: DataFrame, boundaries: np.ndarray) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(boundaries)
    narrow = keyed.select("h", "doc_id", "row", "size", "text_crc32")
    return narrow.mapInArrow(
        lambda x: _range_batches(x, shared), "h long, doc_id long, row long, size long, text_crc32 long, range int"
    )


def _sample(rows: DataFrame, chance, seed: int) -> list:
    """Keys drawn with ``chance``, each with the weight it stands for."""
    drawn = F.pmod(F.xxhash64("h", "doc_id", "row", F.lit(seed)), F.lit(1 << 40)) < chance * (1 << 40)
    return rows.where(drawn).withColumn("weight", F.greatest(F.col("size"), F.col("size") / chance)).collect()


def _quantiles(sample: list, cuts: int, within: bool = True) -> np.ndarray:
    """Keys at which a sorted, weighted sample is cut into ``cuts`` parts of about equal weight.

    Cuts fall between texts, so equal texts stay in one range, unless the sample shows one text only and cuts
    ``within`` it are asked for.
    """
    if not sample or cuts < 2:
        return np.empty(0, "S24")
    keys = _key_bytes(*(np.array([-(1 << 63) if r[c] is None else r[c] for r in sample], np.int64) for c in ("h", "doc_id", "row")))
    weights = np.array([r["weight"] for r in sample], np.float64)
    order = np.argsort(keys)
    before = np.cumsum(weights[order]) - weights[order] / 2
    part = np.minimum(before * cuts / weights.sum(), cuts - 1).astype(np.int64)
    sorted_keys = keys[order]
    cut = sorted_keys[np.flatnonzero(part[1:] != part[:-1]) + 1]
    text = np.array([k.ljust(24, b"\0")[:8] for k in sorted_keys.tolist()], "S8")
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    if not within or len(first) > 1:
        held = np.add.reduceat(weights[order], first)
        heavy = np.flatnonzero(held * cuts > weights.sum())  # such a text gets a range of its own
        alone = text[first[np.r_[heavy, heavy[heavy + 1 < len(first)] + 1]]]
        cut = np.concatenate([np.array([k.ljust(24, b"\0")[:8] for k in cut.tolist()], "S24"), alone.astype("S24")])
    return np.unique(cut)


def splitters(keyed: DataFrame, total: int, ranges: int, group_bytes: float) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Boundaries, and (bytes, rows) of every range they make. Groups of equal texts beyond ``group_bytes`` are cut."""
    mean = max(1, total / ranges)
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(ranges * SAMPLE / max(1, total)))
    boundaries = _quantiles(_sample(keyed.select("h", "doc_id", "row", "size"), chance, 0), ranges, False)
    turn = 0
    while True:
        turn += 1
        ranged = _ranged(keyed, boundaries)
        held = {r["range"]: (r["bytes"], r["rows"]) for r in
                ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = {k: b for k, (b, n) in held.items() if n > 1 and (b > OVERFULL * mean or n > OVERFULL * RANGE_ROWS)}
        if not over or turn == TURNS:
            return boundaries, held
        sizes = F.create_map(*[F.lit(x) for k, b in over.items() for x in (k, float(b))])
        parts = {k: max(2, -(-held[k][0] // int(mean + 1)), -(-held[k][1] // RANGE_ROWS)) for k in over}
        shares = F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, float(n * SAMPLE))])
        inside = ranged.where(F.col("range").isin(list(over)))
        chance = F.least(F.lit(1.0), F.col("size") * shares[F.col("range")] / sizes[F.col("range")])
        by_range: dict[int, list] = {}
        for row in _sample(inside, chance, turn):
            by_range.setdefault(row["range"], []).append(row)
        fresh = [_quantiles(rows, parts[k], held[k][0] > group_bytes) for k, rows in by_range.items()]
        more = np.unique(np.concatenate([boundaries, *fresh]))
        if len(more) == len(boundaries):
            return boundaries, held
        boundaries = more


def deal(held: dict[int, tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """(shard, first slot) of every range: largest range first, to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    shard_of = {}
    for key in sorted(held, key=lambda k: (-held[k][0], k)):
        size, shard = heapq.heappop(heap)
        shard_of[key] = shard
        heapq.heappush(heap, (size + held[key][0], shard))
    slots, placed = [0] * shards, {}
    for key in sorted(held):
        placed[key] = (shard_of[key], slots[shard_of[key]])
        slots[shard_of[key]] += held[key][1]
    return placed


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    text = F.col(text_col).cast("string")
    bytes_of = F.coalesce(text, F.lit("")).cast("binary")
    return hand_over(docs.select(
        F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        (F.octet_length(bytes_of) + EXTRA_BYTES).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    ), "keyed")


def _placed(keyed: DataFrame, shards: int) -> DataFrame:
    """(row, shard, slot) of every row; slots count from 0 in each shard, in key order within a range."""
    spark = keyed.sparkSession
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * PIECES, -(-rows // RANGE_ROWS))
    boundaries, held = splitters(keyed, total, ranges, total / shards / GROUP_SHARE)
    table = [(k, shard, slot) for k, (shard, slot) in deal(held, shards).items()]
    places = spark.createDataFrame(table, "range int, shard int, first_slot long")
    in_order = Window.partitionBy("range").orderBy("h", "doc_id", "row")
    numbered = _ranged(keyed, boundaries).withColumn("n", F.row_number().over(in_order) - 1)
    return numbered.join(F.broadcast(places), "range").select(  # one row per range
        "row", "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("n")).alias("slot")
    )


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    keyed = _keyed(docs, id_col, text_col, [])
    return _placed(keyed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """The rows of ``docs`` as Parquet, a folder per shard, with the slot of each row."""
    keyed = _keyed(docs, id_col, text_col, docs.columns)
    rows = keyed.select("row", F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("record"))
    placed = rows.join(_placed(keyed, shards).select("row", "shard", "slot"), "row")
    placed.select("shard", "slot", "record").write.partitionBy("shard").parquet(path)
