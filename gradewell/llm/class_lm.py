"""Language model scores from Brown classes: exchange clustering, class transitions and word emissions.

1. Each scan task writes its texts as chunks: token numbers, and the chunk's own vocabulary with training counts. The words
   are dealt over blocks by their checksum; the words of one chunk and block are one row, their numbers binary arrays.
2. Each block adds up the exact counts of its words over the whole corpus, and every chunk gets back the counts of
   its own words. What is shuffled is one entry per distinct word and chunk, never one per token.
3. Classes grow with the cube root of the vocabulary. Exchange clustering moves the most frequent words, four to a class,
   between classes while the likelihood of the class bigrams rises.
4. Then every other word seen twice or more in training is placed. A sweep adds up the symbols before and after each word over
   all chunks and moves the word to the class in which its places are likeliest against the class table of the sweep before;
   the first sweep sees seeds and bands of counts as neighbours, the second the classes of all words. Words of one place
   share a class, as do unseen ones.
5. A text's probability is the product of class transitions (interpolated with class frequencies) and of word emissions
   (count of the word over count of its class). After each class, an unseen word is as likely as a word seen once was in
   training (the Good-Turing estimate), and the rest is scaled down for it.

Only bigrams of seeds and of classes reach the driver: (4 classes + 48)^2 numbers at most, a cube-root law. A word that is not
a seed has one entry per chunk of 16 MB in the sweeps. A task holds one block, the words of about 32 MB of text; there are more
blocks as the text grows, never larger ones. Null text counts as empty and has just its end token. A null id counts as the empty
text in the choice of held-out documents; repeated rows each count and are scored alike. Very long texts make chunks of their own.
Ties go to the word lower in byte order (seeds) and to the lower class.
Without training tokens every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import fold, hand_over, let_go, partitions_for, shuffles_freed

FOLDS, HELD_OUT = 7, 2
# Every word seen so often in training is placed in a class.
MIN_COUNT = 2
# Seed words for each class, sweeps of the exchange over the seeds, and sweeps that place all other words.
SEEDS, SWEEPS, PLACINGS = 4, 6, 2
# Symbols behind those of seeds or classes: the number of binary digits of a word's count (0 for unseen words).
BANDS = 48
# Strength of the class frequencies against transitions.
PRIOR = 20.0
CHUNK_BYTES = 16 << 20
# Text for each block of the vocabulary.
BLOCK_BYTES = 32 << 20
_WIDE = 0xFFFF


def class_count(types: int) -> int:
    """Classes grow with the cube root of the vocabulary: 72 for 370,000 words, 1,000 for a billion."""
    return max(8, round(types ** (1 / 3)))


# --- 1. Chunks ----------------------------------------------------------------------------------------------------

_ENCODED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("wide", pa.binary()),
                      ("block", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("local", pa.binary()), ("n", pa.binary())])
_ENCODED_DDL = ("chunk long, doc_id long, held_out boolean, ids binary, wide binary, block int, words binary, sizes binary, local binary, "
                "n binary")


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values between each two edges as one binary value."""
    offsets, raw = edges.astype(np.int64) * values.itemsize, np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: np.dtype | str) -> np.ndarray:
    """The values of all rows, one behind the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _edges(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Where the values of each row begin and end in what :func:`_unpacked` returns."""
    return np.r_[0, np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64) // width)]


def _spelled(letters: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' tokens as numbers, one text behind the other, the tokens of each text, and the word of each number.

    Words are cut and lower-cased for all texts at once. Number 0 is the end of a text, written as the empty word.
    """
    raw = _LOWERED[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # each text ends with a space, so starts and ends alternate
    starts, ends = edges[::2], edges[1::2]
    spelled = _spelled(raw[inside], ends - starts).dictionary_encode()
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    numbers = np.insert(spelled.indices.to_numpy().astype(np.uint32) + 1, last, 0)
    return numbers, np.diff(last, prepend=0) + 1, pa.concat_arrays([pa.array([b""], pa.large_binary()), spelled.dictionary])


def _encode_batches(batches: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts as token numbers (16 bits, wider ones apart), then the words of each chunk, block by block.

    Number 0 is the end of a text, written as the empty word; the others go by frequency, so most fit 16 bits.
    """
    # A chunk's number is its task's number times 2^12 plus its place there.
    chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 12
    docs, size = [], 0

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ENCODED], schema=_ENCODED
        )

    def flush() -> Iterator[pa.RecordBatch]:
        doc_ids, held_out, texts = zip(*docs)
        numbers, lengths, words = _numbered(texts)
        n = len(words)
        total = np.bincount(numbers, minlength=n)
        trained = np.bincount(numbers[~np.repeat(np.array(held_out, bool), lengths)], minlength=n)
        order = np.r_[0, 1 + np.argsort(-total[1:], kind="stable")]
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        ranked = np.split(rank[numbers], np.cumsum(lengths)[:-1])
        yield batch_of(
            len(docs), chunk=[chunk] * len(docs), doc_id=doc_ids, held_out=held_out,
            ids=[np.minimum(x, _WIDE).astype("<u2").tobytes() for x in ranked],
            wide=[x[x >= _WIDE].astype("<u4").tobytes() for x in ranked],
        )
        block = (np.fromiter(map(crc32, words.to_numpy(zero_copy_only=False)), np.uint32, n) % blocks).astype(np.int32)[order]
        local = np.argsort(block, kind="stable")
        found, first = np.unique(block[local], return_index=True)
        edges, spelled = np.r_[first, n], words.take(pa.array(order[local]))
        sizes = pc.binary_length(spelled).to_numpy()
        letters = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)
        yield batch_of(
            len(found), chunk=np.full(len(found), chunk), block=found, words=_packed(letters, np.r_[0, np.cumsum(sizes)][edges]),
            sizes=_packed(sizes.astype("<u4"), edges), local=_packed(local.astype("<i4"), edges),
            n=_packed(trained[order][local].astype("<i8"), edges),
        )

    for batch in batches:
        for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
            text = text.as_py() or b""
            docs.append((doc_id, held_out, text))
            size += len(text) + 50
            if size > CHUNK_BYTES:
                yield from flush()
                chunk, docs, size = chunk + 1, [], 0
                if not chunk % (1 << 12):
                    raise ValueError("a task reads over 4096 chunks of text; lower spark.sql.files.maxPartitionBytes")
    if docs:
        yield from flush()


# --- 2. and 3. Symbols and contexts -------------------------------------------------------------------------------

_ENTRY = np.dtype([("key", "<u2"), ("n", "<u4")])
_PAIR = np.dtype([("pair", "<u4"), ("n", "<u4")])

_COUNTED = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("local", pa.binary()), ("place", pa.binary()), ("c", pa.binary()),
                      ("types", pa.int64()), ("tokens", pa.int64()), ("word", pa.binary()), ("word_id", pa.int64()), ("word_c", pa.int64())])
_COUNTED_DDL = "chunk long, block long, local binary, place binary, c binary, types long, tokens long, word binary, word_id long, word_c long"


def _count_block(found: pa.Table, most: int) -> pa.Table:
    """One block: count and place in the block of each chunk's words, the ``most`` frequent words, and how many words and tokens there are.

    A word's number is its block's number times 2^32 plus its place there. The empty word, the end of a text, is always among the words.
    """
    block, edges = found["block"][0].as_py(), _edges(found["sizes"], 4)
    words = _spelled(b"".join(found["words"].to_pylist()), _unpacked(found["sizes"], "<u4")).dictionary_encode()
    place = words.indices.to_numpy()
    counts = np.zeros(len(words.dictionary), np.int64)
    np.add.at(counts, place, _unpacked(found["n"], "<i8"))
    least = max(1, int(np.partition(counts, -most - 1)[-most - 1])) if len(counts) > most else 1  # the end may be one of them
    often = np.flatnonzero(counts >= least)
    named = zip(counts[often].tolist(), words.dictionary.take(pa.array(often)).to_pylist(), often.tolist())
    top = sorted((-c, w, i) for c, w, i in named if w)[:most]
    end = words.dictionary.index(pa.scalar(b"", pa.large_binary())).as_py()
    if end >= 0:
        top.append((-int(counts[end]), b"", end))
    rows = len(found)
    slices = {"chunk": found["chunk"], "block": pa.array([block] * rows), "local": found["local"],
              "place": _packed(place.astype("<i4"), edges), "c": _packed(counts[place].astype("<i8"), edges)}
    totals = {"types": pa.array([int((counts > 0).sum())]), "tokens": pa.array([int(counts.sum())])}
    frequent = {"word": pa.array([w for _, w, _ in top], pa.binary()), "word_id": pa.array([(block << 32) + i for _, _, i in top], pa.int64()),
                "word_c": pa.array([-c for c, _, _ in top], pa.int64())}
    return pa.concat_tables([
        pa.table([some.get(f.name, pa.nulls(n, f.type)) for f in _COUNTED], schema=_COUNTED)
        for n, some in ((rows, slices), (1, totals), (len(top), frequent))
    ])


def _labelled(words: pa.Table, seeds: np.ndarray, seed_symbols: np.ndarray, heads: int) -> tuple[np.ndarray, ...]:
    """Count, symbol and word number of each token number of a chunk, and which of them are words to be placed.

    Symbols under ``heads`` are words or classes; behind them stand the bands of words with less than ``MIN_COUNT``.
    """
    placed, counted = (words.filter(pc.equal(words["class"].is_valid(), there)) for there in (True, False))
    local = _unpacked(counted["local"], "<i4")
    n = max(1, len(local))  # each number stands in one of the blocks
    counts, ids = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    counts[local] = _unpacked(counted["c"], "<i8")
    ids[local] = np.repeat(counted["block"].to_numpy() << 32, np.diff(_edges(counted["local"], 4))) + _unpacked(counted["place"], "<i4")
    symbols = heads + np.minimum(np.frexp(counts.astype(np.float64))[1], BANDS - 1)
    symbols[_unpacked(placed["local"], "<i4")] = _unpacked(placed["class"], "<i4")
    at = np.minimum(np.searchsorted(seeds, ids), len(seeds) - 1)
    is_seed = seeds[at] == ids
    symbols[is_seed] = seed_symbols[at[is_seed]]
    return counts, symbols.astype(np.int64), ids, (counts >= MIN_COUNT) & ~is_seed


def _numbers(ids: bytes, wide: bytes) -> np.ndarray:
    numbers = np.frombuffer(ids, "<u2").astype(np.int64)
    numbers[numbers == _WIDE] = np.frombuffer(wide, "<u4")
    return numbers


_CONTEXTS = pa.schema([("bigrams", pa.binary()), ("block", pa.int64()), ("chunk", pa.int64()), ("place", pa.binary()), ("local", pa.binary()),
                       ("sizes", pa.binary()), ("contexts", pa.binary())])
_CONTEXTS_DDL = "bigrams binary, block long, chunk long, place binary, local binary, sizes binary, contexts binary"


def _contexts(docs: pa.Table, words: pa.Table, seeds: np.ndarray, seed_symbols: np.ndarray, heads: int) -> pa.Table:
    """One chunk: the symbol bigrams of its training texts, and for each word to be placed the symbols after and before it."""
    if not docs.num_rows:
        return _CONTEXTS.empty_table()
    _, symbols, ids, wanted = _labelled(words, seeds, seed_symbols, heads)
    total = heads + BANDS
    texts = [_numbers(i, w) for i, w, held in zip(*(docs[c].to_pylist() for c in ("ids", "wide", "held_out"))) if not held]
    numbers = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
    now = symbols[numbers]
    before = np.roll(now, 1)
    before[starts] = symbols[0]  # an end stands before each text
    pairs, n = np.unique(before * total + now, return_counts=True)
    table = np.empty(len(pairs), _PAIR)
    table["pair"], table["n"] = pairs, n

    follows = np.roll(now, -1)
    local = np.flatnonzero(wanted)
    local = local[np.argsort(ids[local])]
    rank = np.zeros(len(ids), np.int64)
    rank[local] = np.arange(len(local))
    mine = wanted[numbers]
    at = rank[numbers[mine]] * (2 * total)
    keys, n = np.unique(np.concatenate([at + follows[mine], at + total + before[mine]]), return_counts=True)
    entries = np.empty(len(keys), _ENTRY)
    entries["key"], entries["n"] = keys % (2 * total), n
    ends = np.r_[0, np.searchsorted(keys, (np.arange(len(local)) + 1) * (2 * total))]
    found, first = np.unique(ids[local] >> 32, return_index=True)
    edges = np.r_[first, len(local)]
    chunk = docs["chunk"][0].as_py()
    return pa.concat_tables([
        pa.table([pa.array([table.tobytes()], pa.binary()), *(pa.nulls(1, f.type) for f in list(_CONTEXTS)[1:])], schema=_CONTEXTS),
        pa.table([pa.nulls(len(found), pa.binary()), pa.array(found), pa.array(np.full(len(found), chunk)),
                  _packed((ids[local] & 0xFFFFFFFF).astype("<i4"), edges), _packed(local.astype("<i4"), edges),
                  _packed(np.diff(ends).astype("<u4"), edges), _packed(entries, ends[edges])], schema=_CONTEXTS),
    ])


def _sum_bigrams(batches: Iterable[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(total * total, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            found = np.frombuffer(blob, _PAIR)
            counts[found["pair"]] += found["n"]
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["pair", "n"])


def _pairs(symbols: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and their predecessors in all texts of a batch, and where each text starts; before a text stands an end."""
    lengths = np.array([len(s) // 2 for s in symbols], np.int64)
    now = np.frombuffer(b"".join(symbols), "<u2").astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[starts] = end
    return before, now, starts


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("emitted", pa.float64()), ("symbols", pa.binary())])
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, symbols binary"


def _symbol_texts(docs: pa.Table, words: pa.Table, seeds: np.ndarray, seed_symbols: np.ndarray, heads: int, tokens: int, types: int) -> pa.Table:
    """One chunk: per text the sums that need counts, and the text as classes."""
    if not docs.num_rows:
        return _SCORED.empty_table()
    counts, symbols, _, _ = _labelled(words, seeds, seed_symbols, heads)
    symbols = symbols.astype("<u2")
    plain, emitted = np.log10(counts + 1.0), np.log10(np.maximum(counts, 1.0))
    out: list[tuple] = []
    constant = np.log10(tokens + 1.0 * (types + 1))
    for doc_id, held_out, ids, wide in zip(*(docs[c].to_pylist() for c in ("doc_id", "held_out", "ids", "wide"))):
        numbers = _numbers(ids, wide)
        out.append((
            doc_id, held_out, len(numbers), int((counts[numbers] > 0).sum()), float(plain[numbers].sum() - len(numbers) * constant),
            float(emitted[numbers].sum()), symbols[numbers].tobytes(),
        ))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SCORED)], schema=_SCORED)


def _text_bigrams(batches: Iterable[pa.RecordBatch], total: int, end: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(total * total, np.int64)
    for batch in batches:
        if batch.num_rows:
            before, now, _ = _pairs(batch.column(0).to_pylist(), end)
            counts += np.bincount(before * total + now, minlength=total * total)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["pair", "n"])


# --- 4. Exchange clustering ---------------------------------------------------------------------------------------

def _information(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol. Symbols from ``words`` on keep classes of their own, behind the ``classes`` ones.

    Each word in turn leaves its class and joins the one where the class bigrams gain most; sweeps end when none moves.
    """
    symbols = len(bigrams)
    total = classes + symbols - words
    member = np.r_[np.arange(words) * classes // max(1, words), classes + np.arange(symbols - words)]
    one_hot = np.eye(total)[member]
    grid = one_hot.T @ bigrams @ one_hot
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    order = np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1))[:words], kind="stable")
    span = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for word in order.tolist():
            own = int(bigrams[word, word])
            after = np.bincount(member, bigrams[word], total)
            ahead = np.bincount(member, bigrams[:, word], total)
            now = member[word]
            after[now] -= own
            ahead[now] -= own
            n_left, n_right = bigrams[word].sum(), bigrams[:, word].sum()
            if not n_left + n_right:
                continue
            grid[now] -= after
            grid[:, now] -= ahead
            grid[now, now] -= own
            left[now] -= n_left
            right[now] -= n_right
            rows, columns = grid[:classes], grid[:, :classes].T
            gain = (_information(rows + after) - _information(rows)).sum(axis=1)
            gain += (_information(columns + ahead) - _information(columns)).sum(axis=1)
            corner = grid[span, span]
            gain += _information(corner + after[:classes] + ahead[:classes] + own) - _information(corner)
            gain -= _information(corner + after[:classes]) + _information(corner + ahead[:classes]) - 2 * _information(corner)
            gain -= _information(left[:classes] + n_left) - _information(left[:classes])
            gain -= _information(right[:classes] + n_right) - _information(right[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[now] + 1e-9:
                best = now
            moved += best != now
            member[word] = best
            grid[best] += after
            grid[:, best] += ahead
            grid[best, best] += own
            left[best] += n_left
            right[best] += n_right
        if not moved:
            break
    return member


def gain_table(bigrams: np.ndarray, member: np.ndarray, classes: int) -> np.ndarray:
    """What one symbol beside a word adds to the log likelihood of the word in each class.

    Rows: symbols after the word, then symbols before it. After: the transition from the class. Before: the transition to the
    class over the class's count, because the class emits the word with the word's count over its own.
    """
    total = int(member.max()) + 1
    one_hot = np.eye(total)[member]
    grid = one_hot.T @ bigrams @ one_hot
    count = grid.sum(axis=0)
    share = (count + 1) / (count + 1).sum()
    chance = np.log((grid + PRIOR * share) / (grid.sum(axis=1, keepdims=True) + PRIOR))
    after, before = chance[:classes].T, chance[:, :classes] - np.log(np.maximum(count[:classes], 1))
    return np.concatenate([after[member], before[member]])


# Words with more contexts than this in a block are summed one by one, the others all at once, context by context.
_MANY = 32


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many contexts each row has, and those of all rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // _ENTRY.itemsize
    return np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", _ENTRY, offsets[-1])[offsets[0] :]


def _summed(entries: np.ndarray, sizes: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The gains of words that have so many of the contexts each, in order."""
    order = np.argsort(-sizes, kind="stable")
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    keys, n = entries["key"].astype(np.intp), entries["n"].astype(np.float64)
    sums = np.zeros((len(sizes), gains.shape[1]))
    many = int(np.searchsorted(-size, -_MANY))
    for i in range(many):
        own = slice(first[i], first[i] + size[i])
        sums[i] = n[own] @ gains[keys[own]]
    for k in range(min(_MANY, int(size[many])) if many < len(size) else 0):
        at = first[many : int(np.searchsorted(-size, -k))] + k
        rows = gains[keys[at]]
        rows *= n[at][:, None]
        sums[many : many + len(at)] += rows
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _best(sums: np.ndarray) -> np.ndarray:
    """The class of the largest gain, equal up to six places being a tie."""
    return np.argmax(np.rint(sums * 1e6), axis=-1).astype(np.int32)


def _place_batches(batches: Iterable[pa.RecordBatch], gains: np.ndarray, block: int = 16_000) -> Iterator[pa.RecordBatch]:
    """The best class of each word, for every row of the word; rows come sorted by word.

    The gain is a sum over contexts, so a word carries one number per class from row to row, however many rows it has. Contexts
    are added up in blocks, over all rows of a word at once.
    """
    word, sums, chunks, locals_ = None, np.zeros(gains.shape[1]), [], []

    def placed() -> pa.RecordBatch:
        chunk, local = np.concatenate(chunks), np.concatenate(locals_)
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(local), pa.array(np.full(len(chunk), _best(sums)))], names=["chunk", "local", "class"])

    for batch in batches:
        ids, chunk, local = (batch.column(i).to_numpy() for i in range(3))
        sizes, entries = _entries(batch.column(3))
        ends, at = np.cumsum(sizes), 0
        while at < len(ids):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + block, "right")))
            own, where = ids[at:stop], np.flatnonzero(np.r_[True, ids[at + 1 : stop] != ids[at : stop - 1]])
            by_word = _summed(entries[done : ends[stop - 1]], np.add.reduceat(sizes[at:stop], where), gains)
            edges = np.r_[where, stop - at]
            if word is not None and own[0] != word:
                yield placed()
                sums, chunks, locals_ = np.zeros(gains.shape[1]), [], []
            by_word[0] += sums
            if len(where) > 1:  # all but the last word of the block are complete
                chunks.append(chunk[at : at + edges[-2]])
                locals_.append(local[at : at + edges[-2]])
                head = np.diff(edges)[:-1].copy()
                head[0] += sum(map(len, chunks[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(chunks)), pa.array(np.concatenate(locals_)), pa.array(np.repeat(_best(by_word[:-1]), head))],
                    names=["chunk", "local", "class"],
                )
                chunks, locals_ = [], []
            word, sums = own[-1], by_word[-1]
            chunks.append(chunk[at + edges[-2] : stop])
            locals_.append(local[at + edges[-2] : stop])
            at = stop
    if chunks:
        yield placed()


_PLACED_DDL = "chunk long, local binary, class binary"


def _place_block(found: pa.Table, gains: np.ndarray) -> pa.Table:
    """The best class of each word of a block, for every chunk that has the word."""
    found = found.sort_by("chunk")
    edges, place, local = _edges(found["local"], 4), _unpacked(found["place"], "<i4"), _unpacked(found["local"], "<i4")
    contexts = _spelled(b"".join(found["contexts"].to_pylist()), _unpacked(found["sizes"], "<u4").astype(np.int64) * _ENTRY.itemsize)
    order = np.argsort(place, kind="stable")
    chunk = np.repeat(found["chunk"].to_numpy(), np.diff(edges))
    rows = [pa.array(place[order]), pa.array(chunk[order]), pa.array(local[order]), contexts.take(pa.array(order))]
    batches = _place_batches([pa.RecordBatch.from_arrays(rows, names=["word_id", "chunk", "local", "contexts"])], gains)
    classes = np.empty(len(order), "<i4")
    classes[order] = np.concatenate([batch.column(2).to_numpy() for batch in batches])
    return pa.table({"chunk": found["chunk"], "local": found["local"], "class": _packed(classes, edges)})


# --- 5. Scores ----------------------------------------------------------------------------------------------------

def log_weights(bigrams: np.ndarray, member: np.ndarray, types: int) -> np.ndarray:
    """log10 of transition over class count, for each pair of classes; the word's own count is added per token."""
    total = int(member.max()) + 1
    one_hot = np.eye(total)[member]
    grid = one_hot.T @ bigrams @ one_hot
    count, before = grid.sum(axis=0), grid.sum(axis=1, keepdims=True)
    unseen, once = total - BANDS, total - BANDS + 1
    if not count.sum():
        return np.zeros((total, total))
    share = (count + 1) / (count + 1).sum()
    chance = (grid + PRIOR * share) / (before + PRIOR)
    new = chance[:, once].copy()
    chance[:, unseen] = 0
    chance /= chance.sum(axis=1, keepdims=True)
    chance *= (1 - new)[:, None]
    chance[:, unseen] = new
    count = np.maximum(count, 1)
    count[unseen] = types + 1
    return np.log10(chance) - np.log10(count)


def _score_batches(batches: Iterable[pa.RecordBatch], weights: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            before, now, starts = _pairs(batch.column(6).to_pylist(), end)
            sums = np.add.reduceat(weights[before, now], starts)
            score = batch.column(5).to_numpy(zero_copy_only=False) + sums
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], names=[*_SCORED.names[:5], "score"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = PLACINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with shuffles_freed(docs.sparkSession):
        return _score_texts(docs, id_col, text_col, sweeps)


def _score_texts(docs: DataFrame, id_col: str, text_col: str, sweeps: int) -> DataFrame:
    spark = docs.sparkSession
    # Numbers that rise from row to row shrink further than under the default.
    packed = partial(hand_over, compression="zstd")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    # Blocks follow from the length of all texts, so that none has more words as the table grows.
    blocks = partitions_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0], BLOCK_BYTES)
    encoded = packed(rows.mapInArrow(partial(_encode_batches, blocks=blocks), _ENCODED_DDL), "lm-chunks")
    vocabulary = encoded.where("block is not null").select("chunk", "block", "words", "sizes", "local", "n")

    n_rows, n_chunks = vocabulary.agg(F.sum(F.octet_length("sizes") / 4), F.count_distinct("chunk")).first()
    # No block need name more words than there would be seeds if all words were different.
    most = SEEDS * class_count(int(n_rows or 0))
    counted = packed(
        vocabulary.repartition(blocks, "block").groupBy("block").applyInArrow(lambda found: _count_block(found, most), _COUNTED_DDL), "lm-counts",
    )
    types, tokens = counted.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    classes = class_count(types)
    # The end of a text (number 0 of every chunk) is always a seed, whatever its count.
    end = [r["word_id"] for r in counted.where("word = X''").select("word_id").collect()]
    named = counted.where("word is not null and word != X''").select("word", "word_id", "word_c")
    frequent = named.orderBy(F.desc("word_c"), "word").limit(SEEDS * classes - 1).select("word_id").collect()
    in_order = np.array((end or [-2]) + [r["word_id"] for r in frequent], np.int64)
    by_id = np.argsort(in_order)
    seeds, seed_symbols, heads = in_order[by_id], by_id.astype(np.int64), len(in_order)

    parts = partitions_for(spark, n_chunks, 4)
    texts = encoded.where("ids is not null").select("chunk", "doc_id", "held_out", "ids", "wide").repartition(parts, "chunk").groupBy("chunk")

    counts = counted.where("local is not null").select("chunk", "block", "local", "place", "c", F.lit(None).cast("binary").alias("class"))
    slices = counts

    def grid_of(found: DataFrame, total: int) -> np.ndarray:
        grid = np.zeros(total * total)
        summed = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        grid[summed["pair"].to_numpy()] = summed["n"].to_numpy()
        return grid.reshape(total, total)

    for sweep in range(sweeps):
        total = heads + BANDS
        contexts = packed(
            texts.cogroup(slices.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
                partial(_contexts, seeds=seeds, seed_symbols=seed_symbols, heads=heads), _CONTEXTS_DDL
            ), f"lm-contexts-{sweep}",
        )
        blobs = contexts.where("bigrams is not null").select("bigrams")
        bigrams = grid_of(blobs.mapInArrow(partial(_sum_bigrams, total=total), "pair long, n long"), total)
        if sweep == 0:
            member = exchange(bigrams, heads, classes)
            seed_symbols = member[seed_symbols]
        else:
            member = np.arange(total)
        gains = gain_table(bigrams, member, classes)
        todo = contexts.where("bigrams is null").drop("bigrams")
        placed = packed(
            todo.repartition(blocks, "block").groupBy("block").applyInArrow(lambda found: _place_block(found, gains), _PLACED_DDL),
            f"lm-classes-{sweep}",
        )
        let_go(contexts)  # both its bigrams and its words are used up
        slices = counts.unionByName(placed, allowMissingColumns=True)
        heads = classes

    total = heads + BANDS
    end_symbol = int(seed_symbols[np.flatnonzero(seeds == in_order[0])[0]])
    scored = packed(
        texts.cogroup(slices.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
            partial(_symbol_texts, seeds=seeds, seed_symbols=seed_symbols, heads=heads, tokens=tokens, types=types), _SCORED_DDL
        ), "lm-symbols",
    )
    trained = scored.where("not held_out").select("symbols")
    bigrams = grid_of(trained.mapInArrow(partial(_text_bigrams, total=total, end=end_symbol), "pair long, n long"), total)
    weights = log_weights(bigrams, np.arange(total), types)
    done = scored.mapInArrow(
        partial(_score_batches, weights=weights, end=end_symbol),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return done.withColumn("train_tokens", F.lit(tokens).cast("long"))
