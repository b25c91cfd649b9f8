"""Greedy token matching from texts (T5, C7): a token vocabulary, a table of vectors, and IDF weights.

Each task writes its pairs in chunks: token numbers, and the chunk's own vocabulary with its reference counts. Those are summed
by token into one vocabulary of the whole input, in which every distinct token meets the vector table once; it is broadcast
if its measured size allows, else joined with frequent tokens salted. A chunk then gets one vector for each of its distinct
tokens, never one per pair, so what is shuffled follows the text whatever the number of pairs that share a word. Pairs are
compared as matrix products inside their chunk. A task holds one chunk: at most about ``CHUNK_WORDS`` tokens of text and
``CHUNK_VOCABULARY`` vectors, or those of ``_STEP`` pairs if these have more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.summary import tokens
from gradewell.plans.skew import lookup_join
from gradewell.session import scratch_path

NAMES = ("match_precision", "match_recall", "match_f1")
CHUNK_WORDS, CHUNK_VOCABULARY = 4 << 20, 1 << 17
# Pairs that are numbered at once.
_STEP = 500


_CODED = [pa.field("_chunk", pa.int64()), pa.field("ref", pa.list_(pa.int32())), pa.field("pred", pa.list_(pa.int32())),
          pa.field("token", pa.string()), pa.field("local", pa.int32()), pa.field("refs", pa.int64())]
_CODED_DDL = "_chunk long, ref array<int>, pred array<int>, token string, local int, refs long"


def _encode(keys: int, most_words: int, most_tokens: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of pairs with token numbers of their chunk, and rows of the chunk's tokens with the number of references that have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        vocabulary: dict[str, int] = {}
        refs, size, fields = np.zeros(0, np.int64), 0, []

        def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in fields], names=[f.name for f in fields])

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(vocabulary)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield batch_of(
                    len(part), _chunk=pa.array([chunk] * len(part)), token=pa.array(part),
                    local=pa.array(np.arange(at, at + len(part), dtype=np.int32)), refs=pa.array(refs[at : at + len(part)]))

        for batch in batches:
            fields = [*list(batch.schema)[:keys], *_CODED]
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                sides = [part.column(keys + i) for i in range(2)]
                lengths = [side.value_lengths().to_numpy() for side in sides]
                coded = pa.concat_arrays([side.flatten() for side in sides]).dictionary_encode()
                numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in coded.dictionary.to_pylist()), np.int32)
                ids = np.split(numbers[coded.indices.to_numpy()], [lengths[0].sum()])
                n = len(vocabulary)
                refs = np.r_[refs, np.zeros(n - len(refs), np.int64)]
                refs += np.bincount(np.unique(np.repeat(np.arange(part.num_rows), lengths[0]) * n + ids[0]) % max(1, n), minlength=n)
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(x)].astype(np.int32)), pa.array(i)) for x, i in zip(lengths, ids)]
                yield batch_of(part.num_rows, _chunk=pa.array([chunk] * part.num_rows), ref=lists[0], pred=lists[1],
                               **{f.name: part.column(i) for i, f in enumerate(fields[:keys])})
                size += len(coded)
                if size > most_words or n > most_tokens:
                    yield from flush()
                    chunk, vocabulary, refs, size = chunk + 1, {}, np.zeros(0, np.int64), 0
        yield from flush()

    return run


def _match(ref_weights: np.ndarray, ref: np.ndarray, weights: np.ndarray, pred: np.ndarray, block: int = 1024) -> tuple[float, float, float]:
    """Weighted means of the best cosines of the predicted and of the reference tokens, and their harmonic mean."""
    if not len(weights) or not len(ref_weights):
        return 0.0, 0.0, 0.0
    best, best_ref = np.empty(len(pred)), np.full(len(ref), -np.inf)
    for start in range(0, len(pred), block):
        cosine = pred[start : start + block] @ ref.T
        best[start : start + block] = cosine.max(axis=1)
        np.maximum(best_ref, cosine.max(axis=0), out=best_ref)
    mean = lambda x, w: float(x @ w / w.sum()) if w.sum() > 0 else 0.0
    precision, recall = mean(best, weights), mean(best_ref, ref_weights)
    both = precision + recall
    return precision, recall, 2 * precision * recall / both if both else 0.0


def _match_chunk(pairs: pa.Table, words: pa.Table, keys: int) -> pa.Table:
    """The scores of one chunk's pairs by the weights and vectors of its tokens."""
    n = words.num_rows
    local, weights = words["local"].to_numpy(), np.zeros(n)
    weights[local] = words["weight"].to_numpy()
    lists = words["vector"].combine_chunks()
    sizes, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes[local] = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts[local] = np.cumsum(sizes[local]) - sizes[local]
    values = lists.flatten().to_numpy(zero_copy_only=False)

    def unit(own: np.ndarray, width: int) -> np.ndarray:
        """Unit rows; a token without a vector of the pair's width is a row of zeros, which is like nothing."""
        matrix, full = np.zeros((len(own), width)), sizes[own] == width
        matrix[full] = values[starts[own[full]][:, None] + np.arange(width)]
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def numbers(side: str) -> list[np.ndarray]:
        column = pairs[side].combine_chunks()
        return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])

    out = []
    for both in zip(numbers("ref"), numbers("pred")) if pairs.num_rows else []:
        (ref, ref_counts), (pred, counts) = (np.unique(x, return_counts=True) for x in both)
        width = max(1, sizes[ref].max(initial=0), sizes[pred].max(initial=0))
        out.append(_match(ref_counts * weights[ref], unit(ref, width), counts * weights[pred], unit(pred, width)))
    scores = [pa.array([row[i] for row in out], pa.float64()) for i in range(3)]
    return pa.table([*[pairs.column(i) for i in range(keys)], *scores], names=[*pairs.column_names[:keys], *NAMES])


def vocabulary(seen: DataFrame, total: int | None, vectors: DataFrame) -> DataFrame:
    """(token, weight, vector): every distinct token of ``seen(token, refs)`` with its vector, null if it has none.

    The weight is ln((total + 1) / (references with the token + 1)), or 1 without a ``total`` number of pairs.
    """
    weight = F.lit(1.0) if total is None else F.log((F.lit(float(total)) + 1) / (F.col("refs") + 1))
    # Vectors of floats travel as such, at half the size.
    kind = vectors.schema["vector"].dataType
    same = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col("vector") if same else F.col("vector").cast("array<double>")
    summed = seen.groupBy("token").agg(F.sum("refs").alias("refs"))
    return summed.join(vectors.select("token", vector.alias("vector")), "token", "left").select("token", weight.alias("weight"), "vector")


def match_texts(
    df: DataFrame, key: Sequence[str], reference: str, prediction: str, vectors: DataFrame, idf: bool = True, null_as_text: bool = False,
) -> DataFrame:
    """T5 from texts: the key columns and match_precision, match_recall, match_f1 of each pair.

    ``vectors(token, vector)`` holds one vector per token, such as an embedding layer's. Keys must be unique. A text without
    tokens matches nothing.
    """
    spark = df.sparkSession
    width = len(key)
    texts = df.select(*key, tokens(reference, null_as_text).alias("_ref"), tokens(prediction, null_as_text).alias("_pred"))
    own = [T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(texts.schema.fields[:width])]
    schema = T.StructType([*own, *T.StructType.fromDDL(_CODED_DDL)])
    plain = texts.toDF(*[f.name for f in own], "_ref", "_pred")
    path = scratch_path(spark, "match-chunks")
    plain.mapInArrow(_encode(width, CHUNK_WORDS, CHUNK_VOCABULARY), schema).write.parquet(path)
    # Read apart, so that the two sides of the cogroup have columns of their own.
    pairs = spark.read.schema(schema).parquet(path).where("token IS NULL")
    words = spark.read.schema(schema).parquet(path).where("token IS NOT NULL").select("_chunk", "token", "local", "refs")
    known = vocabulary(words.select("token", "refs"), pairs.count() if idf else None, vectors)
    looked_up = lookup_join(words.drop("refs"), known, ["token"], "left", spread=["_chunk"]).drop("token")
    scored = T.StructType([*own, *[T.StructField(n, T.DoubleType()) for n in NAMES]])
    out = pairs.select(*[f.name for f in own], "_chunk", "ref", "pred").groupBy("_chunk").cogroup(looked_up.groupBy("_chunk")).applyInArrow(
        lambda left, right: _match_chunk(left, right, width), scored)
    return out.toDF(*texts.columns[:width], *NAMES)
