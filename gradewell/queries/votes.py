"""Votes over repeated trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import votes
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.registry import query
from gradewell.queries.scoring import rounded
from gradewell.registry import AXES, LETTERS, NUM_TRIALS

# Events as answers: the model by user, the trial by event, the axis by event type, and a free-text answer.
# Users of model "none" never give a usable answer.
_MODELS = ("base", "f", "t", "none")
_ANSWERS = ("a", "I choose B", " A ", "(b", "neither", None, "b")
_VALUES = (("E", "I"), ("S", "N"), ("T", "F"), ("J", "P"), ("E", "I"))
_TYPES = ("click", "error", "purchase", "signup", "view")


def answers(spark, sf):
    events = v.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    model = v.pick(F.pmod("user_id", F.lit(4)), _MODELS)
    said = v.pick(F.pmod(F.col("event_id") * 5 + F.col("user_id"), F.lit(7)), _ANSWERS)
    first, second = F, F
    for name, (a, b) in zip(_TYPES, _VALUES):
        first = first.when(F.col("event_type") == name, a)
        second = second.when(F.col("event_type") == name, b)
    return events.select(
        "event_id", model.alias("model"), (F.pmod("event_id", F.lit(12)) + 1).alias("trial"),
        F.when(model != "none", said).otherwise("no answer").alias("prediction"),
        F.struct(first.alias("value")).alias("choice_a"), F.struct(second.alias("value")).alias("choice_b"),
    )


def _value_case(side: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{p[side]}'" for t, p in zip(_TYPES, _VALUES)) + " END"


_MODEL_SQL = v.pick_sql("user_id % 4", v.quoted(_MODELS))
_ANSWERS_SQL = f"""answers AS (
  SELECT event_id, {_MODEL_SQL} AS model, event_id % 12 + 1 AS trial,
         CASE WHEN {_MODEL_SQL} = 'none' THEN 'no answer'
              ELSE {v.pick_sql('(event_id * 5 + user_id) % 7', v.quoted(_ANSWERS))} END AS prediction,
         {_value_case(0)} AS value_a, {_value_case(1)} AS value_b FROM events),
chosen AS (
  SELECT model, trial, CASE WHEN right(lower({q.strip('prediction')}), 1) = 'a' THEN value_a ELSE value_b END AS letter
  FROM answers WHERE right(lower({q.strip('prediction')}), 1) IN ('a', 'b')),
tally AS (SELECT model, trial, {', '.join(f"count(*) FILTER (letter = '{x}') AS {x}" for x in LETTERS)}
  FROM chosen GROUP BY model, trial),
types AS (SELECT model, trial, {' || '.join(f"CASE WHEN {a} >= {b} THEN '{a}' ELSE '{b}' END" for a, b in AXES)} AS type
  FROM tally),
running AS (SELECT model, trial, type, count(*) OVER (PARTITION BY model, type ORDER BY trial) AS running
  FROM types{{capped}}),
counted AS (
  SELECT r.model, r.trial, r.type FROM running r
  LEFT JOIN (SELECT model, min(trial) AS stop FROM running WHERE running >= 6 GROUP BY model) s ON s.model = r.model
  WHERE stop IS NULL OR trial <= stop),
type_votes AS (SELECT model, type, count(*) AS n, min(trial) AS first FROM counted GROUP BY model, type),
axis_votes AS (
  SELECT model, axis, letter, count(*) AS n, min(trial) AS first FROM (
    {' UNION ALL '.join(f"SELECT model, trial, '{a}/{b}' AS axis, substr(type, {i + 1}, 1) AS letter FROM counted"
                        for i, (a, b) in enumerate(AXES))}) GROUP BY model, axis, letter),
best_type AS (SELECT model, type FROM type_votes QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, first) = 1),
best_axis AS (SELECT model, axis, letter FROM axis_votes
  QUALIFY row_number() OVER (PARTITION BY model, axis ORDER BY n DESC, first) = 1)"""


def _sql(select: str, cap: int | None = None) -> str:
    return v.with_sql(_ANSWERS_SQL.replace("{capped}", "" if cap is None else f" WHERE trial <= {cap}"), select=select)


def _types(spark, sf):
    return votes.trial_types(votes.letter_tally(votes.chosen_letters(answers(spark, sf))))


@query("J5_questionnaire_grid", """
SELECT model, trial, s_suppkey AS number,
       'You are answering an MBTI personality test.' || chr(10) ||
       'For the question, select either choice_a or choice_b.' || chr(10) ||
       'Respond with only one word: ''a'' or ''b''.' || chr(10) || chr(10) || 'Q' || s_suppkey || ': ' || s_name ||
       chr(10) || 'A: nation ' || s_nationkey || ' (a)' || chr(10) || 'B: another (b)' AS prompt
FROM supplier CROSS JOIN (VALUES ('base'), ('f'), ('t')) m(model) CROSS JOIN (SELECT unnest(range(1, 11)) AS trial)""")
def j5_questionnaire(spark, sf):
    nation = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    questions = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("number"), F.col("s_name").alias("question"),
        F.struct(nation.alias("text"), F.lit("E").alias("value")).alias("choice_a"),
        F.struct(F.lit("another").alias("text"), F.lit("I").alias("value")).alias("choice_b"),
    )
    grid = votes.questionnaire_prompts(questions, v.MODEL_NAMES)
    return grid.select("model", F.col("trial").cast("long").alias("trial"), "number", "prompt")


@query("A23_letter_tally", _sql("SELECT * FROM tally"))
def a23(spark, sf):
    return votes.letter_tally(votes.chosen_letters(answers(spark, sf)))


@query("A24_type_per_trial", _sql("SELECT * FROM types"))
def a24(spark, sf):
    return _types(spark, sf)


@query("A25_type_counts", _sql("SELECT model, type, n, first FROM type_votes"))
def a25(spark, sf):
    return votes.type_counts(votes.counted_trials(_types(spark, sf)))


@query("A25_axis_counts", _sql("SELECT * FROM axis_votes"))
def a25_axes(spark, sf):
    return votes.axis_counts(votes.counted_trials(_types(spark, sf)))


@query("W1_running_counts", _sql("SELECT * FROM running"))
def w1(spark, sf):
    return votes.running_counts(_types(spark, sf))


@query("W2_early_stop", _sql("SELECT * FROM counted"))
def w2(spark, sf):
    return votes.counted_trials(_types(spark, sf))


@query("W2_early_stop_of_first_trials", _sql("SELECT * FROM counted", NUM_TRIALS))
def w2_first_trials(spark, sf):
    return votes.counted_trials(_types(spark, sf), cap=NUM_TRIALS)


@query("W3_most_voted_type", _sql("SELECT * FROM best_type"))
def w3(spark, sf):
    return votes.most_voted(votes.type_counts(votes.counted_trials(_types(spark, sf))), ["model"], "type")


@query("K3_top_letter_per_axis", _sql("SELECT * FROM best_axis"))
def k3(spark, sf):
    return votes.most_voted(votes.axis_counts(votes.counted_trials(_types(spark, sf))), ["model", "axis"], "letter")


_AXIS = " || ".join(f"coalesce(max(letter) FILTER (axis = '{a}/{b}'), '?')" for a, b in AXES)


_VOTE = f"""
SELECT m.model, coalesce(b.type, 'N/A') AS type, coalesce(x.type_by_axis, '????') AS type_by_axis,
       coalesce(c.trials, 0) AS trials
FROM (SELECT DISTINCT model FROM answers) m LEFT JOIN best_type b ON b.model = m.model
LEFT JOIN (SELECT model, {_AXIS} AS type_by_axis FROM best_axis GROUP BY model) x ON x.model = m.model
LEFT JOIN (SELECT model, count(*) AS trials FROM counted GROUP BY model) c ON c.model = m.model"""


@query("C14_questionnaire_vote", _sql(_VOTE))
def c14(spark, sf):
    return votes.vote(answers(spark, sf))


@query("C14_vote_of_first_trials", _sql(_VOTE, NUM_TRIALS))
def c14_first_trials(spark, sf):
    return votes.vote(answers(spark, sf), cap=NUM_TRIALS)


# Parts as questions with the brand and the type as options. The answer follows the position for some part
# sizes, the content for others, and names neither for the rest.
def probe(spark, sf):
    parts = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("question_id"), "p_size", F.col("p_name").alias("question"),
        F.col("p_brand").alias("option_a"), F.col("p_type").alias("option_b"),
    )
    answered = v.per_model(votes.both_orders(parts))
    index = F.pmod(F.col("p_size") * F.col("k") + F.col("c"), F.lit(4))
    said = v.pick(index, (F.col("option_1"), F.col("option_2"), F.col("option_a"), "neither"))
    return answered.select(
        "model", "question_id", "order", "option_1", "option_2",
        F.concat(F.lit("Q: "), "question", F.lit("\nassistant\nI take "), said).alias("prediction"),
    )


@query("C15_order_swap_probe", f"""
WITH probe AS (
  SELECT m.model, p_partkey AS question_id, o.ord,
         CASE o.ord WHEN 'a,b' THEN p_brand ELSE p_type END AS option_1,
         CASE o.ord WHEN 'a,b' THEN p_type ELSE p_brand END AS option_2, p_brand, (p_size * m.k + m.c) % 4 AS pick
  FROM part CROSS JOIN (VALUES ('a,b'), ('b,a')) o(ord) CROSS JOIN {v.MODELS_SQL}),
said AS (SELECT *, 'i take ' || lower(CASE pick WHEN 0 THEN option_1 WHEN 1 THEN option_2 WHEN 2 THEN p_brand
  ELSE 'neither' END) AS text FROM probe),
placed AS (SELECT model, question_id, ord, CASE WHEN contains(text, lower(option_1)) THEN 1
  WHEN contains(text, lower(option_2)) THEN 2 END AS place FROM said),
pairs AS (SELECT a.model, a.place AS ab, b.place AS ba FROM placed a JOIN placed b
  ON a.model = b.model AND a.question_id = b.question_id AND a.ord = 'a,b' AND b.ord = 'b,a')
SELECT model, count(*) FILTER (ab IS NOT NULL AND ba IS NOT NULL) AS answered, count(*) FILTER (ab = ba) AS by_position,
       round(CAST(count(*) FILTER (ab = ba) AS DOUBLE) / count(*) FILTER (ab IS NOT NULL AND ba IS NOT NULL), 6)
         AS position_share
FROM pairs GROUP BY model""")
def c15(spark, sf):
    return rounded(votes.order_effect(probe(spark, sf)), "position_share")
