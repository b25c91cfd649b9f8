"""Quality rules: counts of every text, and how public tokenizers split it, judged by bands of its script.

Each word is measured once per block by two public vocabularies: a piece vocabulary with byte fallback (tokens, byte
tokens, token ids) and a byte-level vocabulary (tokens). A document's measures are sums over its words:

    chars_per_piece, chars_per_byte_token   code points in words per token of either vocabulary
    byte_share                              share of piece tokens that are single fallback bytes
    entropy                                 bits per piece token in the document's own token distribution

Texts of one script and one power of two of tokens form a group. A band runs from the lower quartile less ``FENCE``
times the spread to the upper quartile plus as much; the spread is the distance of the quartiles, at least a stated
floor. Quartiles come from all texts that pass the base rules, every distinct text once, so that a group of copies
cannot move them. A group of fewer than ``LEAST_TEXTS`` takes the band of all sizes of its script, which says nothing
of entropy because that grows with the size; a script of fewer has no band, and the base rules alone judge its texts.

Null and empty texts have no words, fail the base rules and have null measures. Very long texts are measured whole; a
word of any length is one unit. Ties cannot arise; rows that repeat get equal results each. An empty table gives an
empty result. Only the id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.llm.common import hand_over

# Base rules of the contract.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
# Bands: quartiles widened by so many spreads; the least spread of each measure; the least number of distinct texts.
FENCE, LEAST_TEXTS = 3.0, 50
SPREADS = {"chars_per_piece": 0.1, "chars_per_byte_token": 0.1, "byte_share": 0.02, "entropy": 0.25}
# Decimals that measures are rounded to before quartiles are taken, so that their state is bounded.
DECIMALS = {"chars_per_piece": 2, "chars_per_byte_token": 2, "byte_share": 3, "entropy": 2}
# Measures that depend on a text's size, which the band of all sizes of a script therefore leaves out.
SIZED = ("low_entropy", "high_entropy")
PIECES, BYTE_TOKENS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[A-Za-z]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
# First and last code points of scripts; ranges of one name add up.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F),
    ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
# Words remembered, piece ids of a word that is not, and characters of texts whose words are looked up together.
_REMEMBERED, _LONG_WORD, _BLOCK = 300_000, 64, 1 << 20
# An odd number whose powers mix the words of a window.
_FACTOR = 0x9E3779B97F4A7C15

MEASURED = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in SPREADS],
])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabularies:
    """Both tokenizers, and what they make of the words seen lately."""

    def __init__(self, pieces: str, byte_tokens: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_tokens, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.byte_tokens = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        # Piece ids of all words one after the other; each word's first place there, number of ids and byte-level tokens.
        self.ids = np.zeros(0, np.int32)
        self.starts, self.sizes, self.byte_counts = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, words: set[str]) -> None:
        """Give every word a place. Words seen before keep theirs until there are many, or long ones among them."""
        if len(self.sizes) > _REMEMBERED or self.sizes[-1:].sum() > _LONG_WORD:
            self._forget()
        new = sorted(words.difference(self.places), key=len)  # a long word comes last
        self.places.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        found = self.pieces.encode(new, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(new))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())]
        self.byte_counts = np.r_[self.byte_counts, np.fromiter((len(self.byte_tokens.encode_ordinary(" " + w)) for w in new), np.int64, len(new))]

    def of(self, words: list[str]) -> np.ndarray:
        """The place of each learned word in ``starts``, ``sizes`` and ``byte_counts``."""
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def pieces_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of the words at ``places``, one word after the other, and how many each has."""
        sizes = self.sizes[places]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[places] - before, sizes)], sizes


@lru_cache(maxsize=2)
def _vocabularies(pieces: str, byte_tokens: str) -> Vocabularies:
    return Vocabularies(pieces, byte_tokens)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words, given as numbers, that lie in a window of ``window`` words found twice or more in the text.

    Where no two windows share a hash, none repeat. Else pairs of numbers of adjoining runs become numbers of runs twice as
    long, which is exact.
    """
    n = len(ids)
    if n <= window:
        return 0
    hashes = np.zeros(n - window + 1, np.uint64)
    for at in range(window):
        hashes += ids[at : n - window + 1 + at].astype(np.uint64) * np.uint64(pow(_FACTOR, at + 1, 1 << 64))
    hashes.sort()
    if (hashes[1:] != hashes[:-1]).all():
        return 0
    ids, length = np.unique(ids, return_inverse=True)[1], 1
    while length < window:
        shift = min(length, window - length)
        ids = np.unique(ids[: len(ids) - shift] * (int(ids.max()) + 1) + ids[shift:], return_inverse=True)[1]
        length += shift
    counts = np.bincount(ids)
    if counts.max() < 2:
        return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if _WORDS.search(line)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters; among equals the one that sorts first. No letter of a listed script: ``other``."""
    if text.isascii():
        return "latin" if _LETTER.search(text) else "other"
    found: Counter = Counter()
    for letter, n in Counter(text).items():
        point = ord(letter)
        for name, first, last in SCRIPTS:
            if first <= point <= last:
                found[name] += n
                break
    return min(found.items(), key=lambda x: (-x[1], x[0]))[0] if found else "other"


def measures(chars: int, places: np.ndarray, seen: Vocabularies) -> tuple:
    """(tokens, code points per piece, per byte-level token, share of byte pieces, entropy in bits)."""
    unique, counts = np.unique(places, return_counts=True)
    ids, sizes = seen.pieces_at(unique)
    byte_tokens = int(seen.byte_counts[unique] @ counts)
    if not len(ids) or not byte_tokens:
        return 0, None, None, None, None
    found, at = np.unique(ids, return_inverse=True)
    times = np.bincount(at, weights=np.repeat(counts, sizes))
    n = float(times.sum())
    entropy = max(0.0, float(np.log2(n) - (times * np.log2(times)).sum() / n))
    return int(n), chars / n, chars / byte_tokens, float(times[seen.is_byte[found]].sum()) / n, entropy


def _measure(pieces: str, byte_tokens: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(pieces, byte_tokens)

        def of(texts: list[str]) -> Iterator[tuple]:
            split = [_WORDS.findall(text) for text in texts]
            vocabularies.learn(set(chain.from_iterable(split)))
            for text, words in zip(texts, split):
                places, chars = vocabularies.of(words), sum(map(len, words))
                yield (len(words), chars, len(_SYMBOLS.findall(text)), repeated_lines(text), repeated_words(places),
                       script_of(text), *measures(chars, places, vocabularies))

        for batch in batches:
            rows, block, size = [], [], 0
            for value in batch.column(2):
                block.append(value.as_py() or "")
                size += len(block[-1])
                if size > _BLOCK:
                    rows += of(block)
                    block, size = [], 0
            rows += of(block)
            columns = zip(*rows) if rows else [[]] * len(MEASURED)
            typed = [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64() if f.dataType == T.LongType() else pa.float64())
                     for c, f in zip(columns, MEASURED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *typed], names=["id", "text_hash", *MEASURED.names])

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: str | None = None, byte_tokens: str | None = None) -> DataFrame:
    """(id, text_hash, counts of the base rules, script, n_tokens, measures): one row per row of ``docs``."""
    text = docs[text_col].cast("string")
    narrow = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = T.StructType([narrow.schema["id"], narrow.schema["text_hash"], *MEASURED])
    return narrow.mapInArrow(_measure(pieces or tokenizer_path(PIECES), byte_tokens or tokenizer_path(BYTE_TOKENS)), schema)


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _size_class() -> Column:
    """The power of two of the number of tokens."""
    return F.coalesce(F.length(F.bin("n_tokens")), F.lit(0)).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """(script, size_class, low_..., high_... per measure), size_class null for all sizes of a script.

    The table has at most one row per script and power of two.
    """
    rounded = [F.round(name, places).alias(name) for name, places in DECIMALS.items()]
    sound = measured.where(~_base_failed() & F.col("entropy").isNotNull())
    distinct = sound.groupBy("text_hash").agg(F.min(F.struct("script", _size_class().alias("size_class"), *rounded)).alias("m")).select("m.*")
    quartiles = [F.percentile(name, [0.25, 0.75]).alias(name) for name in SPREADS]
    grouped = distinct.groupBy("script", "size_class").agg(F.count("*").alias("n"), *quartiles).unionByName(
        distinct.groupBy("script").agg(F.count("*").alias("n"), *quartiles).withColumn("size_class", F.lit(None).cast("int")))

    def edges(name: str, least: float) -> list[Column]:
        low, high = F.col(name)[0], F.col(name)[1]
        reach = FENCE * F.greatest(high - low, F.lit(least))
        return [(low - reach).alias(f"low_{name}"), (high + reach).alias(f"high_{name}")]

    return grouped.where(F.col("n") >= LEAST_TEXTS).select(
        "script", "size_class", *[e for name, least in SPREADS.items() for e in edges(name, least)])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: str | None = None, byte_tokens: str | None = None) -> DataFrame:
    """One row per document: the id, the base counts, ``base_failed``, ``kept``, and the measures behind the verdict."""
    measured = hand_over(measure(docs, id_col, text_col, pieces, byte_tokens), "fertility")
    found = hand_over(bands(measured), "bands")
    own = found.where("size_class IS NOT NULL")
    whole = found.where("size_class IS NULL").drop("size_class")
    sides = [f"{side}_{name}" for name in SPREADS for side in ("low", "high")]
    whole = whole.select("script", *[(F.lit(None) if s in SIZED else F.col(s)).alias(f"all_{s}") for s in sides])
    joined = measured.withColumn("size_class", _size_class()).join(F.broadcast(own), ["script", "size_class"], "left").join(
        F.broadcast(whole), "script", "left")
    edge = {s: F.coalesce(F.col(s), F.col(f"all_{s}")) for s in sides}
    inside = F.lit(True)
    for name in SPREADS:
        inside &= F.coalesce(F.col(name).between(edge[f"low_{name}"], edge[f"high_{name}"]), F.lit(True))
    return joined.withColumn("base_failed", _base_failed()).select(
        F.col("id").alias(id_col), *MEASURED.names[:5], "base_failed", (~F.col("base_failed") & inside).alias("kept"), "script", "n_tokens", *SPREADS)

