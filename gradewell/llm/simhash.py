"""Near duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect binary Golay code (23, 12) gives every
segment one nearest codeword; the codewords nearest to the segment and to its one-bit neighbours are one or a few
12-bit indices. Two segments that differ in one bit have the nearest index of each among the indices of the other.
When two fingerprints differ in at most two bits, the pigeonhole principle leaves two cases: two segments are equal
(key: both), or one is equal and the others differ in one bit each (key: the equal one, and for the others the nearest
index of one with the indices of the other). Rows of equal keys are compared bit by bit, so results are exact: every
pair within two bits shares a key, and no other pair passes.

Words are runs without ASCII white space, A-Z lower-cased; shingles are three words, repeats included. A text without
words (null too) has fingerprint zero and is linked like any other. Null ids never name a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.llm.common import hand_over, partitions_for
from gradewell.llm.components import components
from gradewell.plans.skew import salted_join

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
WIDTHS = (22, 21, 21)
# Equal keys with more rows than this are compared through one-bit neighbours instead of in pairs.
PAIRED_ROWS = 48
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, most significant bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        hashes = digest(joined, SEED)
    else:
        ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE_WORDS - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows)).tobytes()


# --- Golay code ---------------------------------------------------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit, and the error of weight up to three that each remainder stands for."""
    of_bit = np.array([_remainder(1 << i) for i in range(23)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    for i in range(23):
        errors[of_bit[i]] = 1 << i
        for j in range(i):
            errors[of_bit[i] ^ of_bit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[of_bit[i] ^ of_bit[j] ^ of_bit[k]] = 1 << i | 1 << j | 1 << k
    return of_bit, errors


_OF_BIT, _ERRORS = _tables()


def remainders(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint32)
    for bit in range(23):
        out ^= np.where(words >> np.uint32(bit) & np.uint32(1), _OF_BIT[bit], np.uint32(0))
    return out


def nearest_index(words: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    rest = remainders(words) if rest is None else rest
    return (words ^ _ERRORS[rest]) >> np.uint32(11)


def near_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the nearest codewords of each word and of its one-bit neighbours, without repeats."""
    rest = remainders(words)
    found = np.empty((len(words), width + 1), np.uint32)
    found[:, width] = nearest_index(words, rest)
    for bit in range(width):
        found[:, bit] = nearest_index(words ^ np.uint32(1 << bit), rest ^ _OF_BIT[bit])
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(fresh)
    return rows, found[rows, columns]


# --- Keys and links -----------------------------------------------------------------------------------------------

def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint; fingerprints within two bits of each other have a key in common."""
    shifts = (64 - WIDTHS[0], WIDTHS[2], 0)
    parts = [
        (prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in zip(shifts, WIDTHS)
    ]
    every = np.arange(len(prints))
    nearest = [nearest_index(x) for x in parts]
    near = [near_indices(x, w) for x, w in zip(parts, WIDTHS)]
    rows, keys = [], []

    def add(row, kind, *fields):
        key = np.full(len(row), kind, np.int64)
        for value, width in fields:
            key = key << width | value.astype(np.int64)
        rows.append(row)
        keys.append(key)

    for equal in range(3):
        p, q = (i for i in range(3) if i != equal)
        add(every, equal, (parts[p], 22), (parts[q], 22))
        row, index = near[q]
        add(row, 3 + equal, (parts[equal][row], 22), (nearest[p][row], 12), (index, 12))
        row, index = near[p]
        other = index != nearest[p][row]  # the equal ones are in the rows above
        row, index = row[other], index[other]
        add(row, 3 + equal, (parts[equal][row], 22), (index, 12), (nearest[q][row], 12))
    return np.concatenate(rows), np.concatenate(keys)


def _neighbour_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs within two bits, without comparing pairs.

    Two fingerprints within two bits have a common one-bit neighbour (or are one another's), and all fingerprints around
    one such point are within two bits of each other; so each is linked to the first around the point.
    """
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    parts = -(-len(prints) * 65 // 4_000_000)
    left, right = [], []
    for part in range(parts):
        points, owners = [], []
        for flip in flips:
            point = prints ^ flip
            here = slice(None) if parts == 1 else (point * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
            points.append(point[here])
            owners.append(prints[here])
        point, owner = np.concatenate(points), np.concatenate(owners)
        order = np.lexsort((owner, point))
        point, owner = point[order], owner[order]
        first = np.ones(len(point), bool)
        first[1:] = point[1:] != point[:-1]
        head = owner[np.maximum.accumulate(np.where(first, np.arange(len(point)), 0))]
        left.append(head[~first])
        right.append(owner[~first])
    return np.concatenate(left), np.concatenate(right)


def run_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (sorted by key) that differ in at most two bits.

    Small runs are compared pair by pair; large ones through one-bit neighbours, whose work is linear in the run.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    paired = np.repeat((lengths > 1) & (lengths <= PAIRED_ROWS), lengths)
    k, f = keys[paired], prints[paired]
    for step in range(1, PAIRED_ROWS):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        a, b = f[same], f[same + step]
        linked = np.bitwise_count(a ^ b) <= MOST_BITS
        left.append(a[linked])
        right.append(b[linked])
    for at, n in zip(starts[lengths > PAIRED_ROWS], lengths[lengths > PAIRED_ROWS]):
        a, b = _neighbour_links(np.unique(prints[at : at + n]))
        left.append(a)
        right.append(b)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _print_batches(batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    row_key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        texts = batch.column(1 + text_at).cast(pa.binary())
        found = [int.from_bytes(fingerprint(x.as_py() or b""), "big", signed=True) for x in texts]
        keys = pa.array(range(row_key, row_key + len(found)), pa.int64())
        row_key += len(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), keys, pa.array(found, pa.int64()), *batch.columns[1:]],
            names=["doc_id", "row_key", "fp", *batch.schema.names[1:]],
        )


def _key_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rows, keys = fuzzy_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows].view(np.int64))], names=["key", "fp"])


def _link_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows to links; the last run of a batch waits for the next batch."""
    held_keys, held_prints = [], []

    def out(keys, prints):
        a, b = run_links(keys, prints)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cut = np.searchsorted(keys, keys[-1])
        if cut:
            yield from out(np.concatenate([*held_keys, keys[:cut]]), np.concatenate([*held_prints, prints[:cut]]))
            held_keys, held_prints = [], []
        elif held_keys and held_keys[0][0] != keys[0]:
            yield from out(np.concatenate(held_keys), np.concatenate(held_prints))
            held_keys, held_prints = [], []
        held_keys.append(keys[cut:])
        held_prints.append(prints[cut:])
    if held_keys:
        yield from out(np.concatenate(held_keys), np.concatenate(held_prints))


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc_id, row_key, fp) and the carried columns as c0, c1, ..., written down once."""
    need = carry if text_col in carry else [*carry, text_col]
    taken = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(need)]
    )
    long = T.LongType()
    schema = T.StructType(
        [T.StructField(n, long) for n in ("doc_id", "row_key", "fp")]
        + [T.StructField(f.name, f.dataType) for f in taken.schema.fields[1:]]
    )
    text_at = need.index(text_col)
    found = taken.mapInArrow(lambda x: _print_batches(x, text_at), schema)
    return hand_over(found.select("doc_id", "row_key", "fp", *[f"c{i}" for i in range(len(carry))]), "fingerprints")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within two bits."""
    spark = prints.sparkSession
    n = prints.count()
    keys = prints.repartition(partitions_for(spark, n, 500_000), "fp").mapInArrow(_key_batches, "key long, fp long")
    dealt = keys.repartition(partitions_for(spark, 32 * n, 4_000_000), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link_batches, "a long, b long")


def _with_root(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints with their smallest row, and with the smallest row of their component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    distinct = hand_over(tagged.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    return rooted, rooted.groupBy("root").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    tagged = _fingerprinted(docs, id_col, text_col, [])
    rooted, firsts = _with_root(tagged)
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return salted_join(tagged, named, ["fp"], "left", ["row_key"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id stays (of rows with the same id, one), with all columns."""
    tagged = _fingerprinted(docs, id_col, text_col, docs.columns)
    _, firsts = _with_root(tagged.select("doc_id", "row_key", "fp"))
    stay = firsts.select(F.col("first.row_key").alias("row_key"))
    rows = tagged.join(stay, "row_key", "left_semi")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
