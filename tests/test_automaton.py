"""Labels of any number and length in texts, against plain containment."""

import random
import time

from gradewell.operators import automaton
from gradewell.operators import distribution as dist


def test_labels_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    labels = [(d, word(rng.randint(0, 4))) for d in ("x", "y") for _ in range(30)] + [("x", "a"), ("x", "a"), (None, "b")]
    texts = [(rng.choice(["x", "y", "z", None]), i, word(rng.randint(0, 12)) if i % 9 else None) for i in range(300)]
    rows = spark.createDataFrame(texts, "dataset string, row_id long, text string")
    table = spark.createDataFrame(labels, "dataset string, label string")
    want = {(d, i, x) for d, i, t in texts for e, x in labels if d is not None and d == e and x and t is not None and x in t}
    for characters in (automaton.PART_CHARACTERS, 100):  # one automaton, and many parts
        found = automaton.find_labels(rows, table, "text", ["row_id"], characters).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want
        rest = automaton.without_labels(rows, table, "text", characters)
        assert rest.columns == rows.columns
        assert {r["row_id"] for r in rest.collect()} == {i for _, i, _ in texts} - {i for _, i, _ in want}


def test_no_labels(spark):
    rows = spark.createDataFrame([("x", 1, "text")], "dataset string, row_id long, text string")
    none = spark.createDataFrame([], "dataset string, label string")
    assert automaton.find_labels(rows, none, "text", ["row_id"]).count() == 0
    assert automaton.without_labels(rows, none, "text").count() == 1


def test_a_hundred_thousand_labels_and_one_of_one_letter(spark):
    labels = spark.range(100_000).selectExpr("'d' AS dataset", "concat('a label of number ', id) AS label").unionByName(
        spark.createDataFrame([("d", "a")], "dataset string, label string"))
    rows = spark.range(2_000).selectExpr(
        "'d' AS dataset", "'m' AS model", "concat(repeat('something as a label of nothing at all ', 20), 'a label of number ', id * 50) AS prediction")
    start = time.time()
    counts = {r["label"]: r["n"] for r in dist.containment_pairs(rows, labels).collect()}
    seconds = time.time() - start
    assert counts["a"] == 2_000 and counts["a label of number 5"] >= 1
    for number in ("50", "99950", "1234"):  # each prefix of a number is a label too
        assert counts.get(f"a label of number {number}", 0) == sum(str(i * 50).startswith(number) for i in range(2_000))
    assert seconds < 60
