"""Scores of free summaries against references."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.stem import stem
from gradewell.functions.text import ratio

ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


# --- n-gram overlap as Spark expressions --------------------------------------------------------

def _present(c: Column | str, null_as_text: bool) -> Column:
    """The text; a missing one is empty, or with ``null_as_text`` (N1) the word ``nan``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("nan" if null_as_text else ""))


def tokens(c: Column | str, null_as_text: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9."""
    clean = F.btrim(F.regexp_replace(F.lower(_present(c, null_as_text)), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def _overlap(ref: Column, pred: Column) -> Column:
    """How many grams two lists share, each as often as both have it.

    Sorted together, the copies of a gram in ``ref`` stand right before those in ``pred``, so one walk with a counter is enough.
    """
    mark = lambda side, words: F.transform(words, lambda w: F.struct(w.alias("gram"), F.lit(side).alias("in_pred")))
    state = lambda gram, left, shared: F.struct(gram.alias("gram"), left.alias("left"), shared.alias("shared"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["gram"] == x["gram"], acc["left"]).otherwise(0)
        used = (x["in_pred"] & (left > 0)).cast("int")
        return state(x["gram"], left - used + (~x["in_pred"]).cast("int"), acc["shared"] + used)

    both = F.array_sort(F.concat(mark(False, ref), mark(True, pred)))
    return F.aggregate(both, state(F.lit(""), F.lit(0), F.lit(0)), step)["shared"]


def rouge_n(
    df: DataFrame, key: Sequence[str], reference: str, prediction: str, sizes: Sequence[int] = (1, 2),
    null_as_text: bool = False,
) -> DataFrame:
    """Per pair the clipped n-gram overlap precision, recall and F1 for each size.

    Grams are counted inside their pair's row; they are neither rows of their own nor shuffled. Only keys and counts
    are grouped, because a key that two rows share is an error.
    """
    # One struct as key: a key column that is constant would otherwise drop out of the known partitioning.
    sides = df.select(
        F.struct(*key).alias("_key"), tokens(reference, null_as_text).alias("_ref"), tokens(prediction, null_as_text).alias("_pred")
    )
    counts = {f"_{side[1]}{n}": F.greatest(F.size(side) - (n - 1), F.lit(0)) for n in sizes for side in ("_ref", "_pred")}
    counts |= {f"_o{n}": _overlap(_grams(F.col("_ref"), n), _grams(F.col("_pred"), n)) for n in sizes}
    counted = sides.select("_key", *[c.alias(name) for name, c in counts.items()])
    totals = counted.groupBy("_key").agg(F.count("*").alias("_rows"), *[F.max(name).alias(name) for name in counts])
    scores = []
    for n in sizes:
        scores += [
            ratio(f"_o{n}", f"_p{n}").alias(f"rouge{n}_precision"),
            ratio(f"_o{n}", f"_r{n}").alias(f"rouge{n}_recall"),
            ratio(2 * F.col(f"_o{n}"), F.col(f"_r{n}") + F.col(f"_p{n}")).alias(f"rouge{n}"),
        ]
    repeated = F.raise_error(F.concat(F.lit("two pairs share the key "), F.to_json("_key"))).cast("boolean")
    return totals.filter(F.when(F.col("_rows") == 1, True).otherwise(repeated)).select("_key.*", *scores)


# --- subsequence scores of one pair ------------------------------------------------------------

_WORD = re.compile("[a-z0-9]+")


def _words(text: str, stemmed: bool) -> list[str]:
    found = _WORD.findall(text.lower())
    return [stem(w) if len(w) > 3 else w for w in found] if stemmed else found


def _f1(overlap: int, n_ref: int, n_pred: int) -> float:
    return 2.0 * overlap / (n_ref + n_pred) if overlap else 0.0


def _lcs_columns(ref: list[str], pred: list[str]) -> Iterator[int]:
    """After each predicted word, a bit set over ``ref`` in which a 0 bit marks a step of the LCS length."""
    places: dict[str, int] = {}
    for i, word in enumerate(ref):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(ref)) - 1
    column = full
    for word in pred:
        match = column & places.get(word, 0)
        column = ((column + match) | (column - match)) & full
        yield column


def lcs_length(ref: list[str], pred: list[str]) -> int:
    """Length of the longest common subsequence, one machine-word operation per 64 reference words."""
    column = (1 << len(ref)) - 1
    for column in _lcs_columns(ref, pred):
        pass
    return len(ref) - column.bit_count()


def _lcs_places(ref: list[str], pred: list[str]) -> set[int]:
    """Reference positions of one longest common subsequence, walked from the end."""
    columns = list(_lcs_columns(ref, pred))
    out, i, j = set(), len(ref), len(pred)
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif columns[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out


def _union_overlap(ref: list[list[str]], pred: list[list[str]]) -> int:
    """Reference words covered by any sentence of the prediction, each word used as often as both sides have it."""
    left_ref = Counter(w for s in ref for w in s)
    left_pred = Counter(w for s in pred for w in s)
    hits = 0
    for sentence in ref:
        covered: set[int] = set()
        for other in pred:
            covered |= _lcs_places(sentence, other)
        for i in sorted(covered):
            word = sentence[i]
            if left_ref[word] > 0 and left_pred[word] > 0:
                left_ref[word] -= 1
                left_pred[word] -= 1
                hits += 1
    return hits


def pair_scores(reference: str, prediction: str, stemmed: bool = False) -> tuple[float, float, float, float]:
    """F1 forms of the four scores of one pair, in the order of ``ROUGE``."""
    ref, pred = _words(reference, stemmed), _words(prediction, stemmed)
    out = []
    for n in (1, 2):
        r, p = (Counter(zip(*[side[i:] for i in range(n)])) for side in (ref, pred))
        out.append(_f1(sum((r & p).values()), r.total(), p.total()))
    out.append(_f1(lcs_length(ref, pred), len(ref), len(pred)))
    ref_sents, pred_sents = ([_words(s, stemmed) for s in t.split("\n") if s] for t in (reference, prediction))
    n_ref, n_pred = sum(map(len, ref_sents)), sum(map(len, pred_sents))
    out.append(_f1(_union_overlap(ref_sents, pred_sents), n_ref, n_pred))
    return tuple(out)


def with_rouge(
    df: DataFrame, reference: str, prediction: str, stemmed: bool = False, null_as_text: bool = False
) -> DataFrame:
    """Add rouge1, rouge2, rougeL, rougeLsum (F1 of each pair) in one pass without any shuffle.

    Subsequence scores need the whole pair at once, so the pair is scored in its own row. A missing text is empty, or
    with ``null_as_text`` the word ``nan``.
    """

    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double, rougeLsum double")
    def score(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
        rows = [pair_scores(r, p, stemmed) for r, p in zip(ref, pred)]
        return pd.DataFrame(rows, columns=list(ROUGE), dtype="float64")

    text = [_present(c, null_as_text) for c in (reference, prediction)]
    return df.withColumn("_scores", score(*text)).select(*df.columns, "_scores.*")


# --- greedy token matching ---------------------------------------------------------------------

def _unit_rows(token_lists: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's token vectors as a matrix of unit rows; None for a missing or empty list."""
    for row in token_lists:
        vectors = row.values if row.is_valid else None
        if vectors is None or len(vectors) == 0:
            yield None
            continue
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        yield np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _greedy(ref: np.ndarray, pred: np.ndarray, block: int = 1024) -> tuple[float, float]:
    """Mean best cosine of the predicted and of the reference tokens, block by block."""
    best_ref = np.full(len(ref), -np.inf)
    total = 0.0
    for start in range(0, len(pred), block):
        cosine = pred[start : start + block] @ ref.T
        total += cosine.max(axis=1).sum()
        np.maximum(best_ref, cosine.max(axis=0), out=best_ref)
    return total / len(pred), float(best_ref.mean())


def with_token_match(df: DataFrame, reference_vectors: str, prediction_vectors: str) -> DataFrame:
    """T5: add match_precision, match_recall, match_f1 from two array<array<float>> columns of token vectors.

    The vectors of a pair lie in its row; similarities are matrix products there, so token pairs are never rows.
    """

    @F.arrow_udf("struct<match_precision: double, match_recall: double, match_f1: double>")
    def score(ref: pa.Array, pred: pa.Array) -> pa.Array:
        out = []
        for r, p in zip(_unit_rows(ref), _unit_rows(pred)):
            precision, recall = (0.0, 0.0) if r is None or p is None else _greedy(r, p)
            both = precision + recall
            out.append((precision, recall, 2 * precision * recall / both if both else 0.0))
        names = ("match_precision", "match_recall", "match_f1")
        return pa.StructArray.from_arrays([pa.array([row[i] for row in out], pa.float64()) for i in range(3)], names)

    scored = df.withColumn("_scores", score(F.col(reference_vectors), F.col(prediction_vectors)))
    return scored.select(*df.columns, "_scores.*")


def mean_scores(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Plain mean of per-pair scores."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("pairs"))
