"""The answer log: every prompt is asked once, whatever happens between."""

import os
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle

from gradewell.operators import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class Killed(BaseException):
    """Not an ``Exception``, so no handler of answers catches it: the worker dies."""


def counting(folder, dies_at=None, fails=()):
    """A factory whose calls leave a line each in ``folder``."""

    def factory(model):
        def answer(text):
            with open(os.path.join(folder, "calls"), "a", encoding="utf-8") as out:
                out.write(f"{model} {text}\n")
            if text == dies_at:
                raise Killed
            if text in fails:
                raise ValueError("no answer")
            return f"{model}:{text}"

        return answer

    return factory


def calls(folder):
    path = os.path.join(folder, "calls")
    return Counter(open(path, encoding="utf-8").read().splitlines()) if os.path.exists(path) else Counter()


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, m, f"p{i % 40}") for i in range(120) for m in ("a", "b")], "row_id long, model string, prompt string")


def test_equal_prompts_are_asked_once_and_reruns_ask_nothing(spark, rows, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    first = scoring.answers_from_log(rows, counting(folder), log, partitions=3, wave_prompts=30)
    assert sorted(tuple(r) for r in first.collect()) == sorted((i, m, f"p{i % 40}", f"{m}:p{i % 40}") for i in range(120) for m in "ab")
    assert first.columns == [*rows.columns, "prediction"]
    assert len(calls(folder)) == 80 and set(calls(folder).values()) == {1}
    again = scoring.answers_from_log(rows, counting(folder), log)
    assert again.count() == 240 and sum(calls(folder).values()) == 80
    more = rows.unionByName(spark.createDataFrame([(1, "c", "p1"), (2, "a", "new")], rows.schema))
    assert scoring.answers_from_log(more, counting(folder), log).where("prediction is null").count() == 0
    assert sum(calls(folder).values()) == 82


def test_a_run_that_dies_half_way_goes_on(spark, rows, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    with pytest.raises(Exception):
        scoring.answers_from_log(rows, counting(folder, dies_at="p17"), log, partitions=2, wave_prompts=8)
    kept = scoring.read_answers(spark, log).count() if os.path.exists(log) else 0
    before = calls(folder)
    done = scoring.answers_from_log(rows, counting(folder), log, partitions=2, wave_prompts=8)
    assert done.where("prediction is null").count() == 0 and done.count() == 240
    after = calls(folder)
    assert sum(after.values()) - sum(before.values()) == 80 - kept
    assert sum(n - 1 for n in after.values()) <= 2 * 8 and (sum(before.values()) < 20 or kept > 0)


def test_failures_are_kept_and_asked_again_on_request(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None)], "row_id long, model string, prompt string")
    log, folder = str(tmp_path / "log"), str(tmp_path)
    failing = counting(folder, fails=("y",))
    got = {r["row_id"]: r["prediction"] for r in scoring.answers_from_log(rows, failing, log).collect()}
    assert got == {1: "a:x", 2: "[Error] no answer", 3: None}
    scoring.answers_from_log(rows, failing, log)
    assert sum(calls(folder).values()) == 2
    got = {r["row_id"]: r["prediction"] for r in scoring.answers_from_log(rows, counting(folder), log, retry_errors=True).collect()}
    assert got == {1: "a:x", 2: "a:y", 3: None} and calls(folder) == {"a x": 1, "a y": 2}


def test_an_empty_table_asks_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "row_id long, model string, prompt string")
    assert scoring.answers_from_log(rows, counting(str(tmp_path)), str(tmp_path / "log")).count() == 0
    assert not calls(str(tmp_path))
