"""Positional postings of chosen words, with DataFrame functions only; the phrase and licence operators use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import RAW_WORD, WORD, hand_over, lower_ascii
from gradewell.plans.skew import BROADCAST_BYTES, byte_size


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def raw_words(text: Column) -> Column:
    """The words of a text in their own case."""
    return F.regexp_extract_all(whole(text), F.lit(RAW_WORD), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(whole(text)), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The words of a text that :func:`words` found and spaces join."""
    return F.split(text, " ")


def small(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``df`` written down and, if its measured size allows, marked for broadcast; whether it was."""
    df = hand_over(df, name)
    fits = byte_size(df) <= BROADCAST_BYTES
    return (F.broadcast(df) if fits else df), fits


def term_counts(docs: DataFrame, text: Column, terms: DataFrame, listed: Callable[[Column], Column] = raw_words) -> DataFrame:
    """(term, n): how often each word of ``terms(term)`` stands in all texts. Counted before the shuffle."""
    terms, _ = small(terms.distinct(), "terms")
    found = docs.select(F.explode(listed(text)).alias("w")).select(F.lower("w").alias("term"))
    return found.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings_in_context(
    docs: DataFrame, keys: list[Column], text: Column, terms: DataFrame, around: int, listed: Callable[[Column], Column] = raw_words,
) -> DataFrame:
    """The index: one row per place of a word of ``terms(term)``: keys, term, pos, n_words, context, at.

    ``context`` holds the word with up to ``around`` words on either side, ``at`` of them before it. Words match in Unicode
    lower case, which is coarser than A-Z lower-casing; the words around, by which matches are verified, are A-Z lower-cased.
    With a small list of terms nothing is shuffled and only found places are written. ``listed`` gives the words of ``text``;
    those of :func:`spaced_words` are lower-cased already.
    """
    terms, fits = small(terms.distinct(), "terms")
    n = len(keys)
    base = docs.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], listed(text).alias("words"))
    placed = base.select(*[f"k{i}" for i in range(n)], "words", F.posexplode("words").alias("pos", "w"))
    placed = placed.withColumn("term", F.lower("w")).drop("w")

    def with_context(df: DataFrame) -> DataFrame:
        start = F.greatest(F.col("pos") - around, F.lit(0))
        window = F.slice("words", start + 1, F.col("pos") - start + 1 + around)
        lowered = window if listed is spaced_words else F.split(lower_ascii(F.concat_ws(" ", window)), " ")
        return df.select(
            *[f"k{i}" for i in range(n)], "term", F.col("pos").cast("long").alias("pos"),
            F.size("words").cast("long").alias("n_words"), lowered.alias("context"), (F.col("pos") - start).alias("at"),
        )

    return with_context(placed.join(terms, "term")) if fits else with_context(placed).join(terms, "term")


def sides(index: DataFrame) -> DataFrame:
    """The context as ``before`` and ``after``, nearest first, ``after`` with the word itself."""
    context, at = F.col("context"), F.col("at")
    return index.withColumn("before", F.reverse(F.slice(context, F.lit(1), at))).withColumn(
        "after", F.slice(context, at + 1, F.size(context) - at)
    ).drop("context", "at")


def postings(docs: DataFrame, keys: list[Column], text: Column, terms: DataFrame, around: int) -> DataFrame:
    """As :func:`postings_in_context`, with the words around on two sides."""
    return sides(postings_in_context(docs, keys, text, terms, around))


def agreement(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("long")
