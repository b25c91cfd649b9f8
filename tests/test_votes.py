"""Votes against a sequential count."""

import random
from collections import Counter

from gradewell.operators import votes
from gradewell.registry import AXES, LETTERS

SCHEMA = "model string, trial long, prediction string, choice_a struct<value:string>, choice_b struct<value:string>"


def sequential(trials, stop, cap):
    types, axes = Counter(), [Counter() for _ in AXES]
    for trial in trials[:cap]:
        tally, valid = Counter(), 0
        for answer, a, b in trial:
            last = answer.strip().lower()[-1:] if answer else ""
            if last in ("a", "b"):
                valid += 1
                tally[a if last == "a" else b] += 1
        if not valid:
            continue
        name = "".join(x if tally[x] >= tally[y] else y for x, y in AXES)
        types[name] += 1
        for axis, letter in zip(axes, name):
            axis[letter] += 1
        if types.most_common(1)[0][1] >= stop:
            break
    best = types.most_common(1)[0][0] if types else "N/A"
    by_axis = "".join(max(a, key=a.get, default="?") for a in axes)
    return best, by_axis, sum(types.values())


def test_vote_equals_sequential_count(spark):
    rng = random.Random(11)
    rows, want, whole = [], {}, {}
    for m in range(25):
        trials = []
        for t in range(14):
            said = ["a", "B ", "maybe b", "none!", None, ""] if rng.random() < 0.8 else ["x", None]
            trial = [(rng.choice(said), *rng.choice(AXES)) for _ in range(rng.randrange(1, 8))]
            trials.append(trial)
            rows += [(f"m{m}", t + 1, answer, (a,), (b,)) for answer, a, b in trial]
        want[f"m{m}"] = sequential(trials, 3, 10)
        whole[f"m{m}"] = sequential(trials, 3, None)
    rows.append(("silent", 1, "no", ("E",), ("I",)))
    want["silent"] = whole["silent"] = ("N/A", "????", 0)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["model"]: tuple(r)[1:] for r in votes.vote(df, stop_count=3, cap=10).collect()}
    assert got == want
    assert {r["model"]: tuple(r)[1:] for r in votes.vote(df, stop_count=3).collect()} == whole


def test_running_counts_keep_every_trial(spark):
    types = spark.range(1, 31).selectExpr("'m' AS model", "id AS trial", "'ESTJ' AS type")
    assert [r["running"] for r in votes.running_counts(types).orderBy("trial").collect()] == list(range(1, 31))


def test_tally_is_complete(spark):
    df = spark.createDataFrame([("m", 1, "a", ("E",), ("I",))], SCHEMA)
    row = votes.letter_tally(votes.chosen_letters(df)).first()
    assert [row[x] for x in LETTERS] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert votes.trial_types(votes.letter_tally(votes.chosen_letters(df))).first()["type"] == "ESTJ"


def test_order_effect(spark):
    questions = spark.createDataFrame([(1, "q", "heart", "mind"), (2, "r", "tea", "milk"), (3, "s", "x1", "x2")],
                                      "question_id long, question string, option_a string, option_b string")
    both = votes.both_orders(questions)
    assert both.count() == 6
    said = {(1, "a,b"): "Heart.", (1, "b,a"): "Mind.", (2, "a,b"): "user assistant MILK", (2, "b,a"): "milk", (3, "a,b"): "x1",
            (3, "b,a"): "neither"}
    rows = [("m", *r, said[r["question_id"], r["order"]]) for r in both.collect()]
    schema = ("model string, question_id long, question string, option_a string, option_b string, order string, "
              "option_1 string, option_2 string, prediction string")
    row = votes.order_effect(spark.createDataFrame(rows, schema)).first()
    assert (row["answered"], row["by_position"], row["position_share"]) == (2, 1, 0.5)
