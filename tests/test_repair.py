"""Relabelling and merging, and the batch scoring job."""

import random

from pyspark import TaskContext
from pyspark.sql import functions as F

from gradewell.operators import repair, scoring
from gradewell.plans import jobs
from gradewell.registry import LABEL_TASKS, RELABEL, LabelTask

TASKS = (LabelTask("imdb_sentiment", "x.csv", "r", {"0": "negative", "1": "positive"}), LABEL_TASKS[1])
SCHEMA = "dataset string, model string, row_id long, text string, gold string, prediction string"


def labellers():
    """Nested functions travel to the workers by value."""

    def imdb():
        def label(text):
            if "boom" in text:
                raise RuntimeError(text)
            return " POSITIVE\n" if "great" in text else "who knows"

        return label

    def mental():
        return lambda text: "depression" if "sad" in text else "something"

    return {"imdb_sentiment": imdb, "mental_sentiment": mental}


def rows():
    rng = random.Random(4)
    said = {"imdb_sentiment": ["Positive", "negative.", "Mixed!", "neutral", "great film", "boom", "hm", None],
            "mental_sentiment": ["Normal", "so sad", "Invalid", "need more information", "depression ok", None]}
    golds = {"imdb_sentiment": "01", "mental_sentiment": ["Normal", "Depression"]}
    return [(d, m, i, f"text {rng.randrange(12)}", rng.choice(golds[d]), rng.choice(said[d]))
            for d in said for m in ("base", "f", "t") for i in range(80)]


def expected_label(dataset, prediction):
    text = "nan" if prediction is None else prediction.strip()
    known, allowed, default = RELABEL[dataset]
    clean = "".join(c for c in text.lower() if "a" <= c <= "z")
    if clean in known:
        return clean
    try:
        raw = labellers()[dataset]()(text).strip().lower()
    except RuntimeError:
        return default
    return raw if raw in allowed else default


def test_repair_by_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    sets = {"imdb_sentiment": ("negative", "positive"), "mental_sentiment": ("normal", "depression")}
    fix = {}
    for d, m, i, text, _, p in data:
        clean = "".join(c for c in (p or "").lower() if "a" <= c <= "z")
        if not any(x in clean for x in sets[d]):
            fix[d, m, text] = expected_label(d, p)
    want = {}
    for d, m, i, text, _, p in data:
        p = fix.get((d, m, text), p)
        if d == "mental_sentiment" and p is not None:
            low = p.strip().lower()
            p = low if low.isalpha() and low.isascii() else "depression" if "depression" in low else "normal" if "normal" in low else p
        want[d, m, i] = p
    out = jobs.repair_labels(df, labellers(), TASKS)
    got = {(r["dataset"], r["model"], r["row_id"]): r["prediction"] for r in out.collect()}
    assert got == want
    table = jobs.open_label_table(out, TASKS)
    total = table.filter("dataset = 'mental_sentiment'").agg(F.sum("base")).first()[0]
    assert total == sum(1 for (d, m, _), p in want.items() if d == "mental_sentiment" and m == "base" and p is not None)


def test_override_changes_valid_rows_too_but_strict_does_not(spark):
    main = spark.createDataFrame([("d", "m", 1, "t", "0", "positive"), ("d", "m", 2, "t", "0", "?"), ("d", "m", 3, "u", "0", "x")], SCHEMA)
    fixes = spark.createDataFrame(
        [("d", "m", 2, "t", "mixed"), ("d", "m", 9, "t", "negative"), ("d", "m", 3, "u", None), ("d", "m", 4, None, "no")],
        "dataset string, model string, row_id long, text string, sentiment_label string",
    )

    def got(df):
        return {r["row_id"]: r["prediction"] for r in df.collect()}

    assert got(repair.override_predictions(main, fixes)) == {1: "negative", 2: "negative", 3: "x"}
    assert got(repair.override_rows(main, fixes)) == {1: "positive", 2: "mixed", 3: "x"}


def test_labeller_sees_each_answer_once(spark, tmp_path):
    folder = str(tmp_path)

    def labeller():
        import uuid

        def label(text):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(text)
            return "positive"

        return label

    df = spark.createDataFrame([("imdb_sentiment", "m", i, f"t{i}", "0", ["hm", "eh ", " eh", "mixed"][i % 4]) for i in range(200)], SCHEMA)
    out = repair.label_unresolved(df, {"imdb_sentiment": labeller}, RELABEL)
    for _ in range(2):
        assert {r[0]: r[1] for r in out.groupBy("sentiment_label").count().collect()} == {"positive": 150, "mixed": 50}
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == ["eh", "hm"]


def test_scoring_job(spark, tmp_path):
    folder = str(tmp_path)

    def factory(model):
        import uuid

        open(f"{folder}/{model}-{uuid.uuid4().hex}", "w").close()

        def answer(prompt):
            if prompt == "p7":
                raise ValueError("no 7")
            return f"{model}:{prompt}"

        return answer

    df = scoring.for_models(spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")), ["a", "b"])
    out = scoring.append_answers(df, factory, partitions=4).collect()
    assert {(r["model"], r["row_id"]): r["prediction"] for r in out} == {
        (m, i): "[Error] no 7" if i == 7 else f"{m}:p{i}" for m in "ab" for i in range(40)}
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    # At most one load of each model per task.
    assert loads.count("a") <= 4 and loads.count("b") <= 4


def test_labeller_runs_in_many_partitions(spark):
    """Thousands of distinct short answers are little data, yet a slow labeller must not see them in one task."""
    invalid = spark.range(9000).selectExpr("'d' AS dataset", "'m' AS model", "id AS row_id", "concat('answer ', id) AS prediction")
    names = ("one", "two", "three", "four", "five", "six")
    out = repair.label_unresolved(invalid, {"d": lambda: lambda _: names[TaskContext.get().partitionId()]},
                                  {"d": ((), names, "none")}, partitions=6)
    assert {r[0] for r in out.select("sentiment_label").distinct().collect()} == set(names)


def test_corrections_go_before_labellers_whatever_their_row_numbers(spark):
    df = spark.createDataFrame([("t", "a", "base", 900, "same text", "1", "bad"), ("t", "a", "base", 901, "same text", "1", "worse")],
                               "task string, dataset string, model string, row_id long, text string, gold string, prediction string")
    tasks = (LabelTask("a", "a.csv", "r", {"0": "negative", "1": "positive"}),)
    fixes = spark.createDataFrame([("a", "base", 3, "same text", "positive")],
                                  "dataset string, model string, row_id long, text string, sentiment_label string")
    out = jobs.repair_labels(df, {"a": lambda: lambda _: "negative"}, tasks, ("base",), {"a": ((), ("negative",), "mixed")}, (), fixes)
    assert {r["prediction"] for r in out.collect()} == {"positive"}
