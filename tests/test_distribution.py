"""Distributions against the published label counts, and operators against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gradewell.operators import distribution as dist
from gradewell.operators import metrics
from gradewell.plans import jobs
from gradewell.registry import LabelTask

MODELS = ("base", "f", "t")
# Label counts (true, base, f, t), and what entropy, divergence and shift they give.
COUNTS = {
    "imdb_sentiment": {"mixed": (0, 516, 1325, 244), "negative": (12500, 12803, 11775, 13253),
                       "neutral": (0, 240, 74, 960), "positive": (12500, 11441, 11826, 10543)},
    "mental_sentiment": {"depression": (15404, 27041, 27934, 27317), "invalid": (0, 261, 238, 121),
                         "normal": (16343, 4445, 3575, 4309)},
    "financial_sentiment": {"bearish": (1789, 2840, 2732, 2503), "bullish": (2398, 5226, 5779, 4386),
                            "invalid": (0, 2, 5, 1), "neutral": (7744, 3863, 3415, 5041)},
    "fiqasa_sentiment": {"invalid": (0, 0, 4, 0), "negative": (363, 587, 511, 550), "neutral": (91, 348, 226, 515),
                         "positive": (719, 238, 432, 108)},
    "imdb_sklearn": {"negative": (4972, 5316, 5157, 5807), "positive": (5028, 4684, 4843, 4193)},
    "sst2": {"invalid": (0, 2, 4, 2), "mixed": (0, 1, 2, 0), "negative": (4471, 5579, 4898, 6118),
             "neutral": (0, 561, 506, 1361), "positive": (5529, 3857, 4590, 2519)},
}
ENTROPY = {
    "financial_sentiment": (1.54343, 1.51482, 1.52968), "fiqasa_sentiment": (1.4868, 1.53867, 1.35057),
    "imdb_sentiment": (1.19041, 1.27194, 1.25647), "imdb_sklearn": (0.99712, 0.99929, 0.98113),
    "mental_sentiment": (0.65123, 0.57014, 0.60825), "sst2": (1.23676, 1.24481, 1.32879),
}
KL = {
    "financial_sentiment": (0.007132, 0.030992), "fiqasa_sentiment": (0.217609, 0.099277),
    "imdb_sentiment": (0.032796, 0.042942), "imdb_sklearn": (0.000732, 0.007025),
    "mental_sentiment": (0.00486, 0.002294), "sst2": (0.016292, 0.100594),
}
SHIFT = {
    ("imdb_sentiment", "negative"): (-8.03, 3.51), ("imdb_sentiment", "positive"): (3.37, -7.85),
    ("mental_sentiment", "normal"): (-19.57, -3.06), ("mental_sentiment", "depression"): (3.3, 1.02),
    ("financial_sentiment", "bearish"): (-3.8, -11.87), ("financial_sentiment", "bullish"): (10.58, -16.07),
    ("financial_sentiment", "neutral"): (-11.6, 30.49), ("fiqasa_sentiment", "negative"): (-12.95, -6.3),
    ("fiqasa_sentiment", "neutral"): (-35.06, 47.99), ("fiqasa_sentiment", "positive"): (81.51, -54.62),
    ("imdb_sklearn", "negative"): (-2.99, 9.24), ("imdb_sklearn", "positive"): (3.39, -10.48),
    ("sst2", "negative"): (-12.21, 9.66), ("sst2", "positive"): (19.0, -34.69),
}
CLASSES = {
    "imdb_sentiment": ("negative", "positive"), "mental_sentiment": ("depression", "normal"),
    "financial_sentiment": ("bearish", "bullish", "neutral"), "fiqasa_sentiment": ("negative", "neutral", "positive"),
    "imdb_sklearn": ("negative", "positive"), "sst2": ("negative", "positive"),
}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(d, label, s, n) for d, labels in COUNTS.items() for label, ns in labels.items()
            for s, n in zip(("true", *MODELS), ns) if n]
    return spark.createDataFrame(rows, "dataset string, label string, source string, n long")


def test_entropy(counts):
    got = {(r[0], r[1]): r[2] for r in dist.entropy(counts, MODELS).collect()}
    for dataset, wants in ENTROPY.items():
        for model, want in zip(MODELS, wants):
            assert got[dataset, model] == pytest.approx(want, abs=6e-6)


def test_entropy_in_nats(counts):
    bits = {(r[0], r[1]): r[2] for r in dist.entropy(counts, MODELS).collect()}
    for r in dist.entropy(counts, MODELS, unit="nats").collect():
        assert r[2] == pytest.approx(bits[r[0], r[1]] * math.log(2), abs=1e-9)


def test_kl(counts):
    got = {(r[0], r[1]): r[2] for r in dist.kl_divergence(counts, MODELS).collect()}
    for dataset, wants in KL.items():
        for model, want in zip(("f", "t"), wants):
            assert got[dataset, model] == pytest.approx(want, abs=6e-7)


def test_kl_every_zero_case_by_definition(spark):
    vectors = {"base": [5, 0, 3, 0, 2], "f": [0, 4, 3, 0, 1], "t": [1, 1, 1, 0, 0]}
    rows = [("d", f"l{i}", m, n) for m, ns in vectors.items() for i, n in enumerate(ns) if n or (m == "f" and i == 3)]
    df = spark.createDataFrame(rows, "dataset string, label string, source string, n long")
    share = {m: [n / sum(ns) or 1e-12 for n in ns] for m, ns in vectors.items()}
    for r in dist.kl_divergence(df, MODELS).collect():
        want = sum(q * math.log2(q / p) for q, p in zip(share[r["model"]], share["base"]))
        assert r["kl"] == pytest.approx(want, abs=1e-9)
    for r in dist.entropy(df, MODELS).collect():
        assert r["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share[r["model"]]), abs=1e-9)


def test_shift(counts):
    got = {(r["dataset"], r["label"], r["model"]): r["shift"] for r in dist.relative_shift(counts, MODELS, places=2).collect()}
    for (dataset, label), wants in SHIFT.items():
        for model, want in zip(("f", "t"), wants):
            assert got[dataset, label, model] == want
    assert got["fiqasa_sentiment", "invalid", "f"] is None


def test_collapse_and_share(counts):
    got = {(r["dataset"], r["source"], r["label"]): r["n"] for r in dist.collapse_invalid(counts, CLASSES).collect()}
    assert got["imdb_sentiment", "base", "invalid"] == 756
    assert got["sst2", "t", "invalid"] == 1363
    assert got["financial_sentiment", "f", "neutral"] == 3415
    shares = dist.share_of_total(dist.collapse_invalid(counts, CLASSES))
    for r in shares.groupBy("dataset", "source").agg(F.sum("share").alias("s")).collect():
        assert r["s"] == pytest.approx(100)


def test_wide(counts):
    got = {(r["dataset"], r["label"]): tuple(r)[2:] for r in dist.wide_counts(counts, ["true", *MODELS]).collect()}
    assert got == {(d, label): ns for d, labels in COUNTS.items() for label, ns in labels.items() if any(ns)}


TASKS = (LabelTask("a", "a.csv", "r", {"0": "negative", "1": "positive"}), LabelTask("b", "b.csv", "r", allowed=("normal",)))


def predictions(spark, seed=5):
    rng = random.Random(seed)
    said = ["Positive", "negative!", "positive or negative", "mixed", None, "abnormal", "Normal"]
    rows = []
    for dataset, golds in (("a", ["0", "1", "2"]), ("b", ["Normal", "normal.", "x"])):
        for model in ("f", "t") if dataset == "b" else MODELS:
            rows += [(dataset, model, i, f"t{i % 7}", rng.choice(golds), rng.choice(said)) for i in range(60)]
    schema = "dataset string, model string, row_id long, text string, gold string, prediction string"
    return rows, spark.createDataFrame(rows, schema)


def letters(x):
    return None if x is None else re.sub("[^a-z]", "", x.lower())


def test_counts_by_brute_force(spark):
    rows, df = predictions(spark)
    sets = jobs.label_sets(TASKS)
    assert sets == {"a": ["negative", "positive"], "b": ["normal"]}
    names = {"a": {"0": "negative", "1": "positive"}, "b": None}
    cleaned = jobs.cleaned_labels(df, TASKS)
    want_true, exact, contained, everything = {}, {}, {}, {}
    for d, m, _, _, g, p in rows:
        gold = letters(names[d].get(g) if names[d] else g)
        if m == ("base" if d == "a" else "f") and gold in sets[d]:
            want_true[d, gold, "true"] = want_true.get((d, gold, "true"), 0) + 1
        p = letters(p)
        if p is None:
            continue
        everything[d, p, m] = everything.get((d, p, m), 0) + 1
        if p in sets[d]:
            exact[d, p, m] = exact.get((d, p, m), 0) + 1
        for label in sets[d]:
            if label in p:
                contained[d, label, m] = contained.get((d, label, m), 0) + 1

    def got(counts):
        return {(r["dataset"], r["label"], r["source"]): r["n"] for r in counts.collect() if r["n"]}

    args = (cleaned, sets, MODELS)
    assert got(dist.exact_counts(*args, pred="cleaned_prediction")) == want_true | exact
    assert got(dist.containment_counts(*args, pred="cleaned_prediction")) == want_true | contained
    assert got(dist.open_counts(*args, pred="cleaned_prediction")) == want_true | everything
    labels = spark.createDataFrame([(d, x) for d, xs in sets.items() for x in xs], "dataset string, label string")
    pairs = dist.containment_pairs(cleaned, labels, "cleaned_prediction")
    assert {(r["dataset"], r["label"], r["model"]): r["n"] for r in pairs.collect()} == contained
    invalid = jobs.label_audit(df, TASKS, MODELS).invalid
    want = {(d, m, i) for d, m, i, _, _, p in rows if not any(x in (letters(p) or "") for x in sets[d])}
    assert {(r["dataset"], r["model"], r["row_id"]) for r in invalid.collect()} == want


def test_gold_labels_serve_where_none_are_configured(spark):
    rows, df = predictions(spark)
    tasks = (TASKS[0], LabelTask("b", "b.csv", "r"))
    audit = jobs.label_audit(df, tasks, MODELS)
    assert {r["label"] for r in audit.table.collect() if r["dataset"] == "b"} == {"normal", "x"}


def test_label_sets_of_any_size(spark):
    """Two datasets of 300 gold labels each, as long words that begin alike."""
    def word(i):
        return "label" + "".join(chr(97 + int(c)) for c in str(i)) + "z"

    rows = [("t", d, m, i, "text", word(i), word(i) if m == "base" else "say" + word(i) + word(i + 1) if m == "f" else None)
            for d in ("p", "q") for m in MODELS for i in range(300)]
    df = spark.createDataFrame(rows, "task string, dataset string, model string, row_id long, text string, gold string, prediction string")
    tasks = [LabelTask(d, f"{d}.csv", "r") for d in ("p", "q")]
    table = {(r["dataset"], r["label"]): (r["true"], r["base"], r["f"], r["t"]) for r in jobs.label_audit(df, tasks, MODELS).table.collect()}
    assert len(table) == 600
    assert table["p", word(0)] == (1, 1, 1, 0) and table["q", word(7)] == (1, 1, 2, 0)
    assert jobs.label_audit(df, tasks, MODELS).invalid.count() == 600
    assert len(jobs.bias_table(df, tasks, MODELS).collect()) == 600
    assert jobs.open_label_counts(df, tasks, MODELS).filter("source = 'true'").count() == 600


def test_rows_of_other_datasets_are_not_invalid(spark):
    _, df = predictions(spark)
    assert {r["dataset"] for r in jobs.label_audit(df, TASKS[:1], MODELS).invalid.select("dataset").distinct().collect()} <= {TASKS[0].name}


def test_bias(spark):
    rows, df = predictions(spark)
    pairs = dist.valid_confusion(jobs.cleaned_labels(df, TASKS), pred="cleaned_prediction")
    sums = dist.distribution_bias(pairs).groupBy("dataset", "model").agg(F.sum("bias").alias("s"), F.sum("pred_ratio").alias("p"))
    for r in sums.collect():
        assert r["s"] == pytest.approx(0, abs=1e-12) and r["p"] == pytest.approx(1)
    matrix = {(r["dataset"], r["label"]): r for r in jobs.bias_table(df, TASKS, MODELS).collect()}
    assert matrix["b", "normal"]["f"] == pytest.approx(0) and matrix["b", "normal"]["base"] == pytest.approx(-1)


def test_valid_rows_and_pairs_agree(spark):
    _, df = predictions(spark)
    cleaned = jobs.cleaned_labels(df, TASKS)
    rows = dist.rows_with_gold_label(cleaned, "gold", "cleaned_prediction").count()
    pairs = dist.valid_pairs(metrics.confusion_counts(cleaned, pred="cleaned_prediction"))
    assert rows == pairs.agg(F.sum("n")).first()[0] > 0
    filtered = dist.valid_confusion(cleaned, pred="cleaned_prediction")
    complete = pairs.filter("gold is not null")
    assert sorted(map(tuple, complete.collect())) == sorted(map(tuple, filtered.collect()))
