"""Documents packed into as few fixed-length token sequences as a swap-based local search can reach.

Each document becomes its token ids and an end id, cut into pieces only where it is longer than a sequence. Full pieces
are sequences of their own. The others are dealt by hash into groups of bounded size; each group is packed best fit,
largest first, and then improved: documents move, or change places one for one or two for one, from an emptier to a
fuller bin whenever that raises the sum of squared fills, so that the emptiest bins run empty; the search of a group ends
when a sweep over all its bins empties none. Bins that stay clearly underfull are taken apart and packed once more together with those of other groups.

Null text counts as empty: its only token is the end id. Ids are not used, so repeated rows and null ids are packed like
any other row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import hand_over

SEQUENCE_TOKENS, END_ID = 4096, 1
# Pieces in one group of the local search.
GROUP_ITEMS = 20_000
# Bins filled less than this share are packed again with those of other groups, at most so often.
UNDERFULL, ROUNDS = 15 / 16, 3
# Text chunks whose ids a worker remembers.
_REMEMBERED = 600_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Byte-level vocabularies spell a byte by its Latin-1 character; those that do not print are moved behind U+0100.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(_UNPRINTED)}


def _plain_word(core: bytes) -> bytes | None:
    """``core`` lower-cased if it is letters up to U+024F only; the tokenizer's clean-up changes nothing else in it.

    Such a run is one word for the tokenizer, and full stops and commas behind it are another.
    """
    if core.isalpha():
        return core.lower()
    word = core.decode().lower()
    return word.encode() if word.isalpha() and max(word) < "\u0250" else None


# A text whose ids by chunks differ from the tokenizer's own where a vocabulary keeps case or white space.
_PROBE = "Éau, The naïve  Don't stop. A\tb\nx 12 3.4 日本語 ﬁ ß.,"


class _Encoder:
    """Token ids of texts as little-endian bytes.

    This tokenizer drops white space and no token spans it, so a text's ids are the ids of its chunks between ASCII
    white space, one after another; the ids of a chunk are remembered. A file for which this fails on a probe is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        want = self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        if b"".join(self.encode([_PROBE.encode()])) != np.array(want, "<u4").tobytes():
            raise ValueError(f"{path}: token ids of this file do not follow from those of a text's chunks")

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        known = self.known
        chunks, size = [], 0
        for text in texts:
            chunks.append(text.split())
            size += len(text)
            if size > 4 << 20:  # bounded work at a time, also for very long texts
                yield from self._join(chunks)
                chunks, size = [], 0
                if len(known) > _REMEMBERED:
                    known.clear()
        yield from self._join(chunks)

    def _join(self, chunks: list[list[bytes]]) -> Iterator[bytes]:
        known = self.known
        new = set().union(*chunks).difference(known) if chunks else set()
        parted, plain, fresh = {}, set(), set()
        for chunk in new:
            core = chunk.rstrip(b".,")
            word = _plain_word(core)
            if word is None:
                fresh.add(chunk)
            else:
                parted[chunk] = (word, chunk[len(core) :])
                plain.add(word)
        fresh.update(tail for _, tail in parted.values())
        fresh = list(fresh.difference(known))
        found = self.tokenizer.encode_batch_fast([c.decode() for c in fresh], add_special_tokens=False)
        known.update((c, np.array(x.ids, "<u4").tobytes()) for c, x in zip(fresh, found))
        spell = self.tokenizer.model.tokenize
        for word in plain.difference(known):
            spelled = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_CHARS)
            known[word] = np.array([t.id for t in spell(spelled)], "<u4").tobytes()
        known.update((c, known[word] + known[tail]) for c, (word, tail) in parted.items())
        for parts in chunks:
            yield b"".join(map(known.__getitem__, parts))


_ENCODERS: dict[str, _Encoder] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("row_key", pa.int64()), ("ids", pa.binary())])


def _piece_batches(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end: int, ids: bool) -> Iterator[pa.RecordBatch]:
    row_key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    last = end.to_bytes(4, "little")
    for batch in batches:
        out: list[tuple] = []
        texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
        for doc_id, tokens in zip(batch.column(0).to_pylist(), _ENCODERS[path].encode(texts)):
            tokens += last
            for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                body = tokens[at : at + 4 * capacity]
                out.append((doc_id, piece, at // 4, len(body) // 4, zlib.crc32(body), row_key, body if ids else None))
                row_key += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    capacity: int = SEQUENCE_TOKENS, end: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, a row key, and the ids as bytes if asked for."""
    path = path or tokenizer_file()
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = taken.mapInArrow(
        lambda x: _piece_batches(x, path, capacity, end, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long, ids binary",
    )
    return found if with_ids else found.drop("ids")


# --- Local search -------------------------------------------------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, n = 0, 0  # bit g is set while a bin with gap g is open
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        wide = open_gaps >> length
        if wide:
            gap = length + (wide & -wide).bit_length() - 1
            where = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, where, n = capacity, n, n + 1
        bins[item] = where
        left = gap - length
        if left:
            by_gap[left].append(where)
            open_gaps |= 1 << left
    return bins


def _totals(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The distinct total lengths of one or two of a bin's pieces, ascending, with the lengths that give each.

    A bin of capacity c has at most about sqrt(2 c) distinct lengths, so there are never more than some c totals.
    """
    sizes, copies = np.unique(own, return_counts=True)
    first, second = np.triu_indices(len(sizes))
    apart = (first != second) | (copies[first] > 1)
    first, second = sizes[first[apart]], sizes[second[apart]]
    totals, at = np.unique(np.r_[sizes, first + second], return_index=True)
    return totals, [(int(sizes[i]),) if i < len(sizes) else (int(first[i - len(sizes)]), int(second[i - len(sizes)])) for i in at.tolist()]


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from ``bins``: every step raises the sum of squared fills; the bins in use never grow in number.

    A sweep takes the bins that are not full, emptiest first, and makes for each the best move or exchange of one or two
    of its pieces against none or one elsewhere, as long as there is one. All pairs count, told by their total length.
    Sweeps go on until one empties no bin, or the lower bound is reached.
    """
    if not len(lengths):
        return bins
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    members: list[list[int]] = [[] for _ in fill]
    for item, where in enumerate(bins.tolist()):
        members[where].append(item)
    least, used = -(-int(lengths.sum()) // capacity), int((fill > 0).sum())

    def step(source: int) -> bool:
        """The move or exchange that raises squared fill most; False if none does."""
        totals, parts = _totals(lengths[members[source]])
        gap = capacity - fill
        # Against one piece of another bin, or against none: the largest total that still fits is the best there.
        others = np.flatnonzero(gap[bins] > 0)
        targets = np.r_[bins[others], np.flatnonzero((gap > 0) & (fill > 0))]
        back = np.r_[lengths[others], np.zeros(len(targets) - len(others), np.int64)]
        at = np.searchsorted(totals, back + gap[targets], side="right") - 1
        gain = np.where(at >= 0, totals[at], 0) - back
        worth = np.where((gain > 0) & (targets != source), gain * (fill[targets] - fill[source] + gain), 0)
        best = int(np.argmax(worth)) if len(worth) else 0
        if not len(worth) or worth[best] <= 0:
            return False
        target, given = int(targets[best]), []
        for size in parts[at[best]]:
            given.append(next(i for i in members[source] if lengths[i] == size and i not in given))
        taken = [int(others[best])] if best < len(others) else []
        for here, there, items in ((source, target, given), (target, source, taken)):
            members[here] = [i for i in members[here] if i not in items]
            members[there] += items
            bins[items] = there
        fill[target] += gain[best]
        fill[source] -= gain[best]
        return True

    emptied = True
    while emptied and used > least:
        emptied = False
        for source in np.argsort(fill, kind="stable").tolist():
            if used == least:
                break
            if not 0 < fill[source] < capacity:
                continue
            while fill[source] and step(source):
                pass
            if not fill[source]:
                used, emptied = used - 1, True
    return bins


_PACKED = pa.schema([*list(_PIECES)[:6], ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())])
_PACKED_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, row_key long, sequence_id long, "
               "offset long, settled boolean")


def _pack_batches(batches: Iterable[pa.RecordBatch], capacity: int, keep_all: bool) -> Iterator[pa.RecordBatch]:
    """One group of pieces; a sequence is named by the row key of its first piece."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    lengths = rows["length"].to_numpy().astype(np.int64)
    keys = rows["row_key"].to_numpy()
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    order = np.lexsort((keys, -lengths, bins))
    ordered, size = bins[order], lengths[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    at = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    before = np.cumsum(size) - size
    fill = np.bincount(bins, weights=lengths)
    settled = np.ones(len(order), bool) if keep_all else fill[ordered] >= UNDERFULL * capacity
    table = rows.select(_PIECES.names[:6]).take(pa.array(order))
    table = table.append_column("sequence_id", pa.array(keys[order][at])).append_column("offset", pa.array(before - before[at]))
    yield from table.append_column("settled", pa.array(settled)).cast(_PACKED).to_batches(max_chunksize=50_000)


def pack(cut: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Rows of :func:`pieces` with a sequence id and the place in the sequence; sequences have no gaps."""
    cut = hand_over(cut.drop("ids"), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row_key"))
    done = [full.withColumn("offset", F.lit(0).cast("long"))]
    rest = cut.where(F.col("length") < capacity)
    for turn in range(ROUNDS):
        groups = -(-rest.count() // GROUP_ITEMS)
        if not groups:
            break
        last = groups == 1 or turn == ROUNDS - 1
        dealt = rest.repartition(groups, F.xxhash64("row_key", F.lit(turn)))
        packed = hand_over(
            dealt.mapInArrow(lambda x, last=last: _pack_batches(x, capacity, last), _PACKED_DDL), "packed"
        )
        done.append(packed.where("settled").drop("settled"))
        if last:
            break
        rest = packed.where("not settled").drop("settled", "sequence_id", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("row_key")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, id_col, text_col, path))
