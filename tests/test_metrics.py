"""Scores against brute force in plain Python."""

import math
import random

import pytest

from gradewell.operators import metrics
from gradewell.plans import jobs


def brute(pairs):
    labels = sorted({x for p in pairs for x in p})
    per = {}
    for label in labels:
        tp = sum(g == p == label for g, p in pairs)
        pred, gold = sum(p == label for _, p in pairs), sum(g == label for g, _ in pairs)
        precision, recall = tp / pred if pred else 0.0, tp / gold if gold else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        per[label] = (precision, recall, f1, gold)
    return per, sum(g == p for g, p in pairs) / len(pairs)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(f"d{rng.randrange(2)}", f"m{rng.randrange(2)}", rng.choice("abc"), rng.choice(["a", "b", "zz", None]))
            for _ in range(400)]


def table(spark, rows):
    return spark.createDataFrame(rows, "dataset string, model string, gold string, prediction string")


def test_macro_and_report(spark, rows):
    df = table(spark, rows)
    macro = {(r["dataset"], r["model"]): r for r in metrics.macro_metrics(df).collect()}
    report = {(r["dataset"], r["model"], r["label"]): r for r in metrics.label_report(df).collect()}
    for key, got in macro.items():
        mine = [(g, p) for d, m, g, p in rows if (d, m) == key]
        usable = [x for x in mine if x[1] is not None]
        per, accuracy = brute(usable)
        assert got["accuracy"] == pytest.approx(accuracy)
        for i, name in enumerate(("precision", "recall", "f1")):
            assert got[name] == pytest.approx(sum(s[i] for s in per.values()) / len(per))
        assert (got["rows"], got["scored"], got["invalid"]) == (len(mine), len(usable), len(mine) - len(usable))
        for label, want in per.items():
            r = report[(*key, label)]
            assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx(want)


def test_weighted_counts_give_the_same(spark, rows):
    df = table(spark, rows)
    counts = metrics.confusion_counts(df)
    assert sum(r["n"] for r in counts.collect()) == len(rows)
    a = sorted(map(tuple, metrics.macro_metrics(df).collect()))
    b = sorted(map(tuple, metrics.macro_metrics(counts, pred="pred", weight="n").collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[2:] == pytest.approx(y[2:])


def test_binary_with_an_empty_group(spark):
    rows = [("d", "m", 1, 1), ("d", "m", 0, 1), ("d", "m", 1, 0), ("d", "m", 1, None), ("d", "none", 1, None)]
    df = spark.createDataFrame(rows, "dataset string, model string, gold int, prediction int")
    got = {r["model"]: r for r in metrics.binary_metrics(df).collect()}
    assert tuple(got["m"])[2:] == pytest.approx((1 / 3, 0.5, 0.5, 0.5, 3))
    assert math.isnan(got["none"]["accuracy"]) and tuple(got["none"])[3:] == (0.0, 0.0, 0.0, 0)


def test_all_unusable_macro_group_stays(spark):
    df = table(spark, [("d", "m", "a", None), ("d", "m", "b", None)])
    row = metrics.macro_metrics(df).first()
    assert (row["accuracy"], row["f1"], row["rows"], row["invalid"]) == (0.0, 0.0, 2, 2)


def test_market_gold_sentinel_stays_a_class(spark):
    df = table(spark, [("d", "m", "0", "bearish"), ("d", "m", "9", "bullish"), ("d", "m", "1", "?")])
    row = jobs.score_market_sentiment(df).first()
    # Classes: bearish (f1 1), __invalid__ gold (0), bullish predicted (0).
    assert (row["accuracy"], row["count"], row["invalid_preds"]) == (0.5, 3, 1)
    assert row["f1"] == pytest.approx(1 / 3)


def test_null_as_text_counts_two_missing_as_equal(spark):
    df = table(spark, [("fiqasa", "m", None, None), ("fiqasa", "m", "positive", "negative")])
    assert jobs.score_finance_tasks(df, null_as_text=True).first()["accuracy"] == 0.5
    assert jobs.score_finance_tasks(df).first()["accuracy"] == 0.0


def test_numeric(spark):
    rows = [("d", "m", "#### 1,200", "I say 5 or $1200"), ("d", "m", "7", "8"), ("d", "m", "x", "8"), ("d", "m", "3", None),
            ("d", "none", "3", "three")]
    got = {r["model"]: tuple(r)[2:] for r in jobs.score_numeric_answers(table(spark, rows)).collect()}
    assert got == {"m": (0.5, 1, 2), "none": (0.0, 0, 0)}


def test_health_is_strict(spark):
    rows = [("d", "m", "Normal.", "normal"), ("d", "m", "Depression", "?"), ("d", "m", "Depression", "deep depression")]
    row = jobs.score_health_sentiment(table(spark, rows)).first()
    assert (row["accuracy"], row["count"]) == (pytest.approx(2 / 3), 3)
    assert row["f1"] == pytest.approx(2 / 3)


def test_choice_tasks(spark):
    rows = [("ARC (easy)", "m", "A", "a)"), ("ARC (easy)", "m", "B", "zzz"), ("BoolQ", "m", "True", "untrue"),
            ("GSM8K", "m", "7", " 7 "), ("GSM8K", "m", "8", "eight")]
    got = {r["dataset"]: tuple(r)[2:] for r in jobs.score_choice_tasks(table(spark, rows)).collect()}
    assert got == {"ARC (easy)": (1.0, 1.0, 1.0, 1.0), "BoolQ": (1.0, 1.0, 1.0, 1.0), "GSM8K": (0.5, None, None, None)}


def test_exact_and_row_counts(spark):
    df = table(spark, [("d", "m", "a", "a"), ("d", "m", "a", "__invalid__"), ("d", "m", "a", None)])
    assert tuple(metrics.row_counts(df, invalid="__invalid__").first())[2:] == (3, 2, 1)
    assert metrics.exact_text_accuracy(df).first()["accuracy"] == 0.5
