"""The trie of all conversations' turns, built from range-partitioned paths and a skeleton of splitter paths.

A conversation's path is the sequence of 16-byte digests of its turns (role and text), so equal prefixes are equal byte
prefixes, and all members of a node lie side by side in the order of paths. Splitters are quantiles of a sample of distinct
paths. The trie of their paths, the skeleton, is broadcast; every node that has members in two shards lies on it, because a
splitter between two paths shares what the two share. Each shard sorts its paths and walks them once with a stack: it
finishes every node that is not on the skeleton, and gives partial sums for those that are. The partial sums of a skeleton
node are added up in a combining aggregate; its own contribution to the nodes above it follows from the summed number
of members and is passed up the skeleton.

Equal paths are one path with a count before they are ranged, so a group of copies is one row. The conversations that end in
a node are hashed in the order of their ids, in a pass that sorts (path, id) and holds one hash.

Bounds: the skeleton has at most ``SKELETON_BYTES`` of splitter paths (longer ones are cut, which leaves them valid
splitters); it, and one row per skeleton node, are all that reaches the driver. A conversation's own turns, 30 bytes each
without their text, are one record.

Nulls: a null role or text is empty; a null turn comes first; turns of equal number are ordered by the digest of role and text.
Rows without a conv_id belong to no conversation and are left out. Rows that repeat are turns of their own. Texts of any length
are only hashed and their words counted. An empty table has no conversations and gives no nodes, not even a root. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import hand_over, partitions_for

BLOCK, HEADS = 20, 4
WIDTH = 16
SKELETON_BYTES, SAMPLE_PER_SHARD, PATHS_PER_SHARD = 16 << 20, 40, 100_000
_WORD = r"[^\x20\x09-\x0D]++"


def turn_digest(role: Column, text: Column) -> Column:
    """Hex MD5 of role and text; the role's length keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): the rebuilt turns of every conversation as digests end to end, and the words of each turn."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(_WORD)).alias("n"))
    # In an array that is sorted, a null turn comes before all numbers.
    own = hand_over(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("turns")), "turns")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("block"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = own.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "block", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), shared)
    rebuilt = F.concat(head, F.slice("turns", shared + 1, F.size("turns") + 1))
    return joined.select("conv_id", rebuilt.alias("turns")).select(
        "conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.n").cast("array<int>").alias("words"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of the conversations as they are."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(_WORD)).alias("n")))).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.n").cast("array<int>").alias("words"))


def _end_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, conv_id) in order to the hash of each path's ids."""
    pid, digest = None, None
    for batch in batches:
        pids, hashes = [], []
        for row_pid, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if row_pid != pid:
                if pid is not None:
                    pids.append(pid)
                    hashes.append(digest.hexdigest())
                pid, digest = row_pid, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.string()), pa.array(hashes, pa.string())], names=["pid", "ends"])
    if pid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([digest.hexdigest()])], names=["pid", "ends"])


def distinct_paths(members: DataFrame, partitions: int) -> DataFrame:
    """(path, words, n, least, ends): every distinct path, its number of conversations, the smallest id, the ids' hash."""
    keyed = members.withColumn("pid", F.sha2("path", 256))
    counted = keyed.groupBy("pid").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path"), F.first("words").alias("words"))
    ends = keyed.select("pid", "conv_id").repartition(partitions, "pid").sortWithinPartitions("pid", "conv_id").mapInArrow(
        _end_hashes, "pid string, ends string")
    return counted.join(ends, "pid").drop("pid")


class Skeleton:
    """The trie of splitter paths. Node 0 is the root; nodes are numbered so that parents come first."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.children: list[dict[bytes, int]] = [{}]
        self.parents = [-1]
        for path in splitters:
            node = 0
            for at in range(0, len(path) - WIDTH + 1, WIDTH):
                turn = path[at : at + WIDTH]
                if turn not in self.children[node]:
                    self.children[node][turn] = len(self.children)
                    self.children.append({})
                    self.parents.append(node)
                node = self.children[node][turn]

    def shard(self, path: bytes) -> int:
        return bisect_right(self.splitters, path)


def splitters(distinct: DataFrame, shards: int) -> list[bytes]:
    """At most ``shards`` - 1 paths that cut the distinct paths into ranges of like size, from a sample by hash.

    The sample's expected size is ``SAMPLE_PER_SHARD`` per shard, its paths are cut so that splitters keep to their bound.
    """
    if shards < 2:
        return []
    longest = max(WIDTH, SKELETON_BYTES // (shards * SAMPLE_PER_SHARD) // WIDTH * WIDTH)
    total = distinct.count()
    share = min(1.0, shards * SAMPLE_PER_SHARD / max(total, 1))
    drawn = distinct.where(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.substring("path", 1, longest).alias("p"))
    sample = sorted(bytes(r["p"]) for r in drawn.collect())
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)} - {b""}) if sample else []


_SHARD = "node int, depth long, conv_id long, parent int, parent_conv_id long, n long, children long, leaves long, saved long, words long, ends string"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
_NAMES = [f.split()[0] for f in _SHARD.split(", ")]


class _Open:
    """A node on the stack: its skeleton number (-1 beside it), words of its last text, and the sums so far.

    ``leaves`` and ``saved`` hold what finished nodes below it give.
    """

    __slots__ = ("number", "words", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, number: int, words: int):
        self.number, self.words = number, words
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: str | None = None
        self.waiting: list[tuple] = []


NO_ENDS = hashlib.sha256(b"").hexdigest()
# Rows of a result batch.
_BATCH = 20_000


def walk(rows: Iterable[tuple[bytes, list[int], int, int, str]], skeleton: Skeleton) -> Iterator[tuple]:
    """Sorted distinct paths of one shard to rows of ``_SHARD``.

    ``node`` is -1 for a finished node; otherwise the row is a skeleton node's partial sums. A node's smallest member is known
    when it closes, so its finished children, at most one per path of the shard, wait with it for their parent's id; below the
    skeleton all of a node's members are in the shard. Children of skeleton nodes name the node in ``parent`` instead.
    """
    stack = [_Open(0, 0)]
    before = b""

    def close() -> Iterator[tuple]:
        depth = len(stack) - 1
        node = stack.pop()
        for child in node.waiting:
            yield child[:4] + (node.least,) + child[5:]
        if node.number >= 0:
            yield (node.number, depth, node.least, -1, None, node.n, node.children, node.leaves, node.saved, node.words, node.ends)
            if stack:
                above = stack[-1]
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
                # What lies below a skeleton node reaches the nodes above it in every shard by itself.
                above.leaves += node.leaves
                above.saved += node.saved
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.words
        above = stack[-1]
        row = (-1, depth, node.least, above.number, None, node.n, node.children, leaves, saved, node.words, node.ends or NO_ENDS)
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.number >= 0:
            yield row
        else:
            above.waiting.append(row)

    for path, words, n, least, ends in rows:
        shared, limit = 0, min(len(before), len(path)) // WIDTH
        while shared < limit and before[shared * WIDTH : (shared + 1) * WIDTH] == path[shared * WIDTH : (shared + 1) * WIDTH]:
            shared += 1
        while len(stack) - 1 > shared:
            yield from close()
        for depth in range(shared, len(path) // WIDTH):
            number = stack[-1].number
            if number >= 0:
                number = skeleton.children[number].get(path[depth * WIDTH : (depth + 1) * WIDTH], -1)
            stack.append(_Open(number, words[depth]))
        top = stack[-1]
        top.n += n
        top.least = least if top.least is None else min(top.least, least)
        top.ends = ends
        before = path
    while stack:
        if len(stack) == 1 and not stack[0].n:
            break
        yield from close()


def _shards(batches: Iterable[pa.RecordBatch], skeleton) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, words, n, least, ends in zip(*(c.to_pylist() for c in batch.columns)):
                yield path, words, n, least, ends

    found: list[tuple] = []
    for row in walk(rows(), skeleton.value):
        found.append(row)
        if len(found) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], names=_NAMES)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], names=_NAMES)


def _assign(batches: Iterable[pa.RecordBatch], skeleton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards = [skeleton.value.shard(p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], names=[*batch.schema.names, "shard"])


def finish(skeleton: Skeleton, sums: dict[int, dict]) -> list[tuple]:
    """Whole rows (number, depth, conv_id, parent_conv_id, ...) of the skeleton's nodes from their added partial sums.

    Children have larger numbers than parents, so one pass from the last to the first hands own contributions up.
    """
    own = {k: [0, 0] for k in sums}
    out = []
    for number in sorted(sums, reverse=True):
        row, below = sums[number], sum(child in sums for child in skeleton.children[number].values())
        children = row["children"] + below
        leaf, saved = (0 if children else 1), (row["n"] - 1) * row["words"]
        own[number][0] += leaf
        own[number][1] += saved
        parent = skeleton.parents[number]
        if parent >= 0:
            own[parent][0] += own[number][0]
            own[parent][1] += own[number][1]
        out.append((number, row["depth"], row["conv_id"], sums[parent]["conv_id"] if parent >= 0 else None, row["n"], children,
                    row["leaves"] + own[number][0], row["saved"] + own[number][1], row["ends"] or NO_ENDS))
    return out


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def trie(members: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``members(conv_id, path, words)``, as the contract names them."""
    spark = members.sparkSession
    members = hand_over(members, "paths")
    total = members.count()
    parts = shards or partitions_for(spark, total, PATHS_PER_SHARD)
    distinct = hand_over(distinct_paths(members, parts), "distinct-paths")
    skeleton = Skeleton(splitters(distinct, parts))
    shared = spark.sparkContext.broadcast(skeleton)
    ranged = distinct.select("path", "words", "n", "least", "ends").mapInArrow(
        lambda b: _assign(b, shared), "path binary, words array<int>, n long, least long, ends string, shard int")
    walked = hand_over(
        ranged.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "path").drop("shard").mapInArrow(
            lambda b: _shards(b, shared), _SHARD), "trie")
    partial = walked.where("node >= 0").groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    whole = finish(skeleton, {r["node"]: r.asDict() for r in partial.collect()})
    bones = spark.createDataFrame(whole, f"number int, {RESULT}".replace("conv_id long, depth long", "depth long, conv_id long", 1))
    above = F.broadcast(bones.select(F.col("number").alias("parent"), F.col("conv_id").alias("bone")))
    local = walked.where("node < 0").join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "bone").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"))
    return local.unionByName(bones.select(*_RESULT_NAMES))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The contract's table: rebuild, then the trie."""
    return trie(rebuilt_paths(conversations))
