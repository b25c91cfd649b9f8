"""Preference pairs from two instruction files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import preferences
from gradewell.queries import views as v
from gradewell.queries.projections import PAIRED_SQL, RECORDS_SQL, _sides, records
from gradewell.queries.registry import query


_FLAT = """
SELECT c.position, c.instruction AS prompt, c.output AS chosen, r.output AS rejected
FROM records c JOIN records r ON r.position = c.position
WHERE c.subtype = 'feeling' AND r.subtype = 'thinking'"""


@query("C12_preference_pairs_flat", v.with_sql(RECORDS_SQL, select=_FLAT))
def c12(spark, sf):
    return preferences.flat_pairs(records(spark, sf), "decision", "feeling")


@query("C12_first_pairs", v.with_sql(RECORDS_SQL, select=_FLAT + " AND c.position < 16000"))
def c12_first(spark, sf):
    return preferences.flat_pairs(records(spark, sf), "decision", "feeling", limit=16000)


def _chat(question: str, answer: str) -> str:
    return f"CAST(to_json([{{'role': 'user', 'content': {question}}}, {{'role': 'assistant', 'content': {answer}}}]) AS VARCHAR)"


_B = "CASE WHEN inst_b <> '' THEN inst_b ELSE inst_a END"


@query("C13_preference_pairs_chat", v.with_sql(RECORDS_SQL, PAIRED_SQL, select=f"""
SELECT position, 'a' AS preferred, {_chat('inst_a', 'out_a')} AS chosen, {_chat('inst_a', 'out_b')} AS rejected,
       8 AS score_chosen, 1 AS score_rejected FROM complete
UNION ALL
SELECT position, 'b', {_chat(_B, 'out_b')}, {_chat(_B, 'out_a')}, 8, 1 FROM complete"""))
def c13(spark, sf):
    return preferences.chat_pairs(*_sides(spark, sf)).select(
        "position", "preferred", "chosen", "rejected", F.col("score_chosen"), F.col("score_rejected")
    )
