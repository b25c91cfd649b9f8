"""Exact duplicates found by compressed radix tries that own the texts of one partition.

Every scan task first puts its rows into small tries, so that a text which a task meets often leaves it once, with a
count. The remaining texts are partitioned by length and content hash, and each partition inserts the full byte
strings into one trie. A terminal node keeps the smallest identifier of its text. Equality is decided by the bytes on
the path to the terminal, never by the hash. A trie that outgrows its memory moves whole subtrees to files of the task
and takes them up one at a time at the end.

Null text counts as empty. Null ids sort after all others. Of rows that repeat the same id and text one stays.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.llm.common import hand_over, partitions_for

# Bytes of text that one trie holds before it flushes (first pass) or spills subtrees (second pass).
COMBINE_BYTES = 24 << 20
TRIE_BYTES = 96 << 20
# Text that one partition of the second pass is meant to hold.
PARTITION_BYTES = 48 << 20
_NODE_BYTES = 300
_LAST = 1 << 63  # sorts a null id behind every other
_WHITE = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    if not text:
        return text
    middle = b" ".join(text.split())
    if not middle:
        return b" "
    return (b" " if text[0] in _WHITE else b"") + middle + (b" " if text[-1] in _WHITE else b"")


class _Node:
    __slots__ = ("label", "children", "entries", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.entries, self.spill = label, {}, None, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``key[at:]``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A radix trie over byte strings; each terminal lists the entries of one string."""

    def __init__(self, limit: int | None = None):
        self.root, self.bytes, self.limit, self.spilled = _Node(b""), 0, limit, 0

    def insert(self, key: bytes, entry: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = _Node(key[at:])
                self.bytes += len(key) - at + _NODE_BYTES
                node = leaf
                break
            if not key.startswith(child.label, at):
                n = _shared(child.label, key, at)
                upper = node.children[key[at]] = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.bytes += _NODE_BYTES
                child = upper
            at += len(child.label)
            if child.spill is not None:
                pickle.dump((key, entry), child.spill)
                return
            node = child
        if node.entries is None:
            node.entries = []
        node.entries.append(entry)
        self.bytes += 100
        if self.limit and self.bytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Move the largest subtrees below the first fork to files until half the limit is free."""
        fork, prefix = self.root, b""
        while len(fork.children) == 1 and not fork.entries:
            (child,) = fork.children.values()
            if child.spill is not None:
                return
            fork, prefix = child, prefix + child.label
        held = sorted(((self._weight(c), c) for c in fork.children.values() if c.spill is None), key=lambda x: -x[0])
        for weight, child in held:
            if self.bytes <= self.limit // 2:
                break
            file = tempfile.TemporaryFile()
            for key, entries in self._groups(child, prefix):
                for entry in entries:
                    pickle.dump((key, entry), file)
            for older in self._spilled_below(child):
                older.seek(0)
                shutil.copyfileobj(older, file)
                older.close()
            child.children, child.entries, child.spill = {}, None, file
            self.bytes -= weight
            self.spilled += 1
        if self.bytes > self.limit:  # nothing left that could go: let it grow and look again later
            self.limit = 2 * self.bytes

    @staticmethod
    def _spilled_below(node: _Node) -> list:
        """Files of subtrees that went earlier."""
        found, stack = [], [node]
        while stack:
            x = stack.pop()
            if x.spill is not None:
                found.append(x.spill)
            stack.extend(x.children.values())
        return found

    @staticmethod
    def _weight(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + _NODE_BYTES + 100 * len(x.entries or ())
            stack.extend(x.children.values())
        return total

    @staticmethod
    def _groups(node: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Every string held below ``node`` with its entries."""
        stack = [(node, prefix)]
        while stack:
            x, before = stack.pop()
            key = before + x.label
            if x.entries:
                yield key, x.entries
            stack.extend((c, key) for c in x.children.values())

    def groups(self) -> Iterator[list]:
        """The entries of each distinct string, also of those in files."""
        files, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x.spill is not None:
                files.append(x.spill)
            elif x.entries:
                yield x.entries
            stack.extend(x.children.values())
        limit, self.root = self.limit, _Node(b"")
        for file in files:
            file.seek(0)
            below = PatriciaTrie(limit)
            while True:
                try:
                    key, entry = pickle.load(file)
                except EOFError:
                    break
                below.insert(key, entry)
            file.close()
            yield from below.groups()


_TAGS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("owner", pa.int64()), ("sha", pa.binary()),
                   ("n", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def _combine(batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows of one scan task, each with the row that owns its text within a chunk.

    Input: the id and the columns to carry, of which number ``text_at`` is the text. Owners carry them on.
    """
    row_key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    trie, rows, hashes, carried, held = PatriciaTrie(), [], {}, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        owner_of, n_of = {}, {}
        for entries in trie.groups():
            _, owner = min(entries)
            n_of[owner] = len(entries)
            owner_of.update((key, owner) for _, key in entries)
        tags = [
            (doc_id, key, owner_of[key], sha, *((n_of[key], length, crc) if owner_of[key] == key else (None,) * 3))
            for doc_id, key, sha, length, crc in rows
        ]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*tags), _TAGS)]
        own, table = columns[4].is_valid(), pa.Table.from_batches(carried)
        for name in table.column_names[1:]:
            column = table[name].combine_chunks()
            columns.append(pc.if_else(own, column, pa.scalar(None, column.type)))
        yield pa.RecordBatch.from_arrays(columns, names=[*_TAGS.names, *table.column_names[1:]])

    for batch in batches:
        begin, texts = 0, batch.column(1 + text_at).cast(pa.binary())
        for at, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
            body = normalised(text.as_py() or b"")
            if body not in hashes:
                hashes[body] = (hashlib.sha256(body).digest(), len(body), zlib.crc32(body))
            trie.insert(body, (_LAST if doc_id is None else doc_id, row_key))
            rows.append((doc_id, row_key, *hashes[body]))
            row_key, held = row_key + 1, held + len(body) + 150
            if held > COMBINE_BYTES:
                carried.append(batch.slice(begin, at + 1 - begin))
                yield from flush()
                begin, trie, rows, hashes, carried, held = at + 1, PatriciaTrie(), [], {}, [], 0
        if begin < batch.num_rows:
            carried.append(batch.slice(begin))
    if rows:
        yield from flush()


_OWNERS = pa.schema([("owner", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one partition into a trie; for each owner of the first pass the row that stays."""
    trie = PatriciaTrie(TRIE_BYTES)
    for batch in batches:
        doc_ids, owners, counts = (batch.column(i).to_pylist() for i in range(3))
        for doc_id, owner, n, body in zip(doc_ids, owners, counts, batch.column(3)):
            trie.insert(normalised(body.as_py() or b""), (_LAST if doc_id is None else doc_id, owner, n))
    out: list[tuple] = []
    for entries in trie.groups():
        keep_id, keep_row, _ = min(entries)
        total = sum(n for _, _, n in entries)
        out.extend((owner, None if keep_id == _LAST else keep_id, keep_row, total) for _, owner, _ in entries)
        if len(out) > 50_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OWNERS)], schema=_OWNERS)


def _tagged(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The first pass, written down once. Carried columns are renamed to c0, c1, ..., so no name can clash."""
    taken = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    )
    long, binary = T.LongType(), T.BinaryType()
    tags = [T.StructField(f.name, binary if f.type == pa.binary() else long) for f in _TAGS]
    kept = [T.StructField(f.name, f.dataType) for f in taken.schema.fields[1:]]
    text_at = carry.index(text_col)
    return hand_over(taken.mapInArrow(lambda x: _combine(x, text_at), T.StructType(tags + kept)), "exact-tagged")


def _owners(tagged: DataFrame, text: str) -> DataFrame:
    """The second pass: each owner of a chunk with the row that stays for its text."""
    spark = tagged.sparkSession
    texts = tagged.where("n is not null")
    total = texts.agg(F.sum("length")).first()[0]
    return (
        texts.repartition(partitions_for(spark, total, PARTITION_BYTES), "length", "crc")
        .select("doc_id", F.col("row_key").alias("owner"), "n", F.col(text).cast("binary"))
        .mapInArrow(_own, "owner long, keep_id long, keep_row long, group_size long")
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the id of the row that stays, group size, whether it stays, and the SHA-256.

    Shuffled text is one copy per distinct text and scan chunk. The join back goes by the owner's row, which stands for
    at most one chunk, so a group that holds a third of all rows is never in one task.
    """
    tagged = _tagged(docs, id_col, text_col, [text_col])
    joined = tagged.select("doc_id", "row_key", "owner", "sha").join(_owners(tagged, "c0"), "owner")
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    tagged = _tagged(docs, id_col, text_col, docs.columns)
    stay = _owners(tagged, f"c{docs.columns.index(text_col)}").where("owner = keep_row").select("owner")
    rows = tagged.where("n is not null").join(stay, "owner", "left_semi")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
