"""Preference pairs from instruction files.

Records are long: ``dimension, subtype, position, instruction, output``. A position is the place of a record
in its file; records of two files are paired by it, so the pairing is an equality join on a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import first_nonblank, trimmed
from gradewell.registry import SCORE_CHOSEN, SCORE_REJECTED, opposite_subtype


def chat_json(user: Column | str, assistant: Column | str) -> Column:
    """a user and an assistant message as JSON text."""

    def message(role: str, content: Column | str) -> Column:
        content = F.col(content) if isinstance(content, str) else content
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(F.array(message("user", user), message("assistant", assistant)))


def zip_by_position(a: DataFrame, b: DataFrame, position: str = "position", limit: int | None = None) -> DataFrame:
    """Record i of a beside record i of b, up to the shorter one or ``limit`` records (positions from 0)."""
    if limit is not None:
        a, b = a.filter(F.col(position) < limit), b.filter(F.col(position) < limit)
    return a.join(b, position, "inner")


def records_of(raw: DataFrame, dimension: str, subtype: str) -> DataFrame:
    """Records of one file; raises if there are none."""
    part = raw.filter((F.col("dimension") == dimension) & (F.col("subtype") == subtype))
    if part.isEmpty():
        raise FileNotFoundError(f"no records for {dimension} / {subtype}")
    return part


def chosen_and_rejected(raw: DataFrame, dimension: str, preferred: str) -> tuple[DataFrame, DataFrame]:
    """The records of the preferred subtype and of its opposite."""
    other = opposite_subtype(dimension, preferred)
    return records_of(raw, dimension, preferred), records_of(raw, dimension, other)


def flat_pairs(raw: DataFrame, dimension: str, preferred: str, limit: int | None = None) -> DataFrame:
    """Prompt, chosen, rejected."""
    chosen, rejected = chosen_and_rejected(raw, dimension, preferred)
    left = chosen.select("position", F.col("instruction").alias("prompt"), F.col("output").alias("chosen"))
    right = rejected.select("position", F.col("output").alias("rejected"))
    return zip_by_position(left, right, limit=limit).select("position", "prompt", "chosen", "rejected")


def complete_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trimmed texts of both files by position, without pairs that lack a needed text."""
    sides = [
        side.select("position", trimmed("instruction").alias(f"inst_{tag}"), trimmed("output").alias(f"out_{tag}"))
        for tag, side in (("a", a), ("b", b))
    ]
    needed = (F.length("inst_a") > 0) & (F.length("out_a") > 0) & (F.length("out_b") > 0)
    return zip_by_position(*sides).filter(needed)


def chat_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chat preferences in both directions; ``preferred`` says which file's answer was chosen.

    The b direction asks b's question, or a's where b's is blank.
    """
    question_b = first_nonblank("inst_b", "inst_a")

    def direction(tag: str, question: Column, chosen: str, rejected: str) -> Column:
        return F.struct(
            F.lit(tag).alias("preferred"),
            chat_json(question, chosen).alias("chosen"),
            chat_json(question, rejected).alias("rejected"),
        )

    both = F.array(direction("a", F.col("inst_a"), "out_a", "out_b"), direction("b", question_b, "out_b", "out_a"))
    return complete_pairs(a, b).select(
        "position", F.inline(both),
        F.lit(SCORE_CHOSEN).alias("score_chosen"), F.lit(SCORE_REJECTED).alias("score_rejected"),
    )
