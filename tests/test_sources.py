"""Readers and writers on small files."""

import pytest
from pyspark.sql import types as T

from gradewell.registry import LABEL_TASKS, MODELS, LabelTask
from gradewell.schema import INPUTS, PREDICTIONS, with_prediction
from gradewell.session import scratch_path
from gradewell.sources import lines, sinks, tables


def test_csv_with_newlines_quotes_and_missing_words(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('text,label\n"a ""b""\nc, d",1\n  padded ,nan\nNA,\n', encoding="utf-8")
    rows = [tuple(r) for r in tables.read_csv(spark, str(path), INPUTS["text_label"]).collect()]
    assert rows == [('a "b"\nc, d', "1"), ("  padded ", None), (None, None)]
    kept = tables.read_csv(spark, str(path), INPUTS["text_label"], missing_to_null=False).collect()
    assert kept[2]["text"] == "NA"


def test_header_mismatch_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("label,text\n1,a\n", encoding="utf-8")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "x.csv"), INPUTS["text_label"]).collect()


def test_byte_order_mark_and_padded_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿ label , prediction\n1,a\n", encoding="utf-8")
    df = tables.read_csv_trimmed(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["label", "prediction"] and tuple(df.first()) == ("1", "a")


def test_bare_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿label,prediction\n1,a\n\n\"2,b\nno comma\n3,c,d\n", encoding="utf-8")
    rows, rejects = lines.read_bare_csv(spark, str(tmp_path / "x.csv"), "label", "prediction")
    assert [tuple(r) for r in rows.collect()] == [("1", "a"), ('"2', "b")]
    assert [r[0] for r in rejects.collect()] == ["3,c,d"]
    with pytest.raises(ValueError):
        lines.read_bare_csv(spark, str(tmp_path / "x.csv"), "answer")


def test_last_two_words(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "text answer prediction\nStocks fell, badly \t negative  Negative\n   \nends with dot.\nüber gut schön\n", encoding="utf-8")
    got = [tuple(r) for r in lines.split_last_words(lines.body_lines(spark, str(tmp_path / "x.csv"))).collect()]
    assert got == [("Stocks fell, badly", "negative", "Negative"), ("über", "gut", "schön")]


def test_indexed_lines(spark, tmp_path):
    body = '"12,a ""fine"" film , 1, Positive"\n7 dull ,"0",negative\n8,odd,2,positive\n9,x,1,mixed\n'
    (tmp_path / "x.csv").write_text("bad header\n" + body, encoding="utf-8")
    rows, rejects = lines.split_indexed(lines.body_lines(spark, str(tmp_path / "x.csv")))
    assert [tuple(r) for r in rows.collect()] == [("12", 'a ""fine"" film', "1", "positive"), ("7", "dull", "0", "negative")]
    assert [r[0] for r in rejects.collect()] == ["8,odd,2,positive", "9,x,1,mixed"]


def test_result_tree(spark, tmp_path):
    task = LABEL_TASKS[1]
    for model, body in (("base", "hi,Normal,normal\nyo,Depression,n/a\n"), ("t", "hi,Normal,Depression\n")):
        folder = tmp_path / task.base_path / MODELS[model]
        folder.mkdir(parents=True)
        (folder / task.file).write_text("text,label,prediction\n" + body, encoding="utf-8")
        (folder / "meqsum_results.csv").write_text("CHQ,Summary,prediction\nx,y,z\n", encoding="utf-8")
    found = tables.read_results(spark, str(tmp_path), task, MODELS, INPUTS["text_label"])
    got = {(r["model"], r["text"], r["gold"], r["prediction"]) for r in found.collect()}
    assert got == {("base", "hi", "Normal", "normal"), ("base", "yo", "Depression", None), ("t", "hi", "Normal", "Depression")}
    nothing = tables.read_results(spark, str(tmp_path), LABEL_TASKS[0], MODELS, INPUTS["text_label"])
    assert nothing.count() == 0
    missing = tables.missing_results(found.unionByName(nothing), LABEL_TASKS[:2], list(MODELS))
    assert {tuple(r) for r in missing.collect()} == {("mental_sentiment", "f"), *[("imdb_sentiment", m) for m in MODELS]}


def test_csv_round_trip_with_mark(spark):
    path = scratch_path(spark, "roundtrip")
    df = spark.createDataFrame([(' a "q"\nb ', "é"), ("x,y", "")], "text string, label string")
    sinks.write_csv(df, path, bom=True)
    back = tables.read_csv_trimmed(spark, path, missing_to_null=False)
    assert sorted(tuple(r) for r in back.fillna("").collect()) == sorted(tuple(r) for r in df.collect())


def test_training_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"n": 2, "prompt": "b"}\n{"n": 1, "prompt": "a"}\n', encoding="utf-8")
    schema = T.StructType().add("n", T.LongType()).add("prompt", T.StringType())
    args = (spark, str(tmp_path / "x.json"), schema, "json")
    assert [r["prompt"] for r in tables.read_training_rows(*args, order=["n"], limit=1).collect()] == ["a"]
    assert tables.read_training_rows(*args).count() == 2
    with pytest.raises(ValueError):
        tables.read_training_rows(*args, limit=1)


def test_report_text(spark):
    df = spark.createDataFrame([("d", "m", 0.48743718, 3)], "dataset string, model string, accuracy double, count long")
    text = sinks.report_text(df, ["dataset", "model"], {"accuracy": 4, "count": None}).first()["value"]
    assert text == "dataset: d\nmodel: m\naccuracy: 0.4874\ncount: 3\n" + "-" * 40


def test_rewrite_refuses_its_own_source(spark):
    with pytest.raises(ValueError):
        sinks.rewrite_table(spark, "/tmp/a", "/tmp/a/", lambda d: d)


def test_a_failing_change_leaves_the_old_version(spark):
    root = scratch_path(spark, "versions")
    assert sinks.current_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root)
    sinks.write_version(spark.range(5), root, 0)
    with pytest.raises(Exception):
        sinks.change_table(spark, root, lambda df: df.selectExpr("id + assert_true(id < 3) AS id", "raise_error('no') AS x"))
    assert sinks.current_version(spark, root) == 1 and sinks.read_version(spark, root).count() == 5
    changed = sinks.change_table(spark, root, lambda df: df.filter("id > 2"))
    assert changed.count() == 2 and sinks.read_version(spark, root).count() == 2
    assert sinks.read_version(spark, root, 1).count() == 5


def test_of_two_writers_one_wins(spark):
    root = scratch_path(spark, "versions")
    sinks.write_version(spark.range(3), root, 0)
    sinks.write_version(spark.range(4), root, 1)
    with pytest.raises(FileExistsError):
        sinks.write_version(spark.range(9), root, 1)
    assert sinks.current_version(spark, root) == 2 and sinks.read_version(spark, root).count() == 4


def test_invalid_output_has_no_empty_folders(spark):
    path = scratch_path(spark, "invalid")
    df = spark.createDataFrame([("d", "f", 1, "x")], "dataset string, model string, row_id long, prediction string")
    sinks.write_invalid(df, path)
    back = spark.read.option("header", True).csv(path)
    assert [(r["dataset"], r["model"]) for r in back.collect()] == [("d", "f")]


def test_prediction_schema():
    assert with_prediction(INPUTS["gsm8k"]).names == ["question", "label", "prediction"]
    assert LabelTask("x", "x.csv", "r").labels() is None


def test_json_arrays_are_bounded_and_ordered(spark):
    path = scratch_path(spark, "arrays")
    df = spark.range(23).selectExpr("23 - id as id", "concat('é', id) as instruction", "cast(null as string) as output")
    sinks.write_json_arrays(df, path, ["instruction", "output"], ["id"], rows_per_file=10)
    back = tables.read_json_array(spark, f"{path}/*.txt")
    sizes = [r["count"] for r in back.groupBy("position").count().orderBy("position").collect()]
    assert sizes == [3] * 3 + [2] * 7 and back.filter("output is not null").count() == 0
    firsts = {r["instruction"] for r in back.filter("position = 0").collect()}
    assert firsts == {"é22", "é12", "é2"}


def test_predictions_as_parquet(spark):
    path = scratch_path(spark, "predictions")
    rows = [("t", "d", "m", 1, "x", "g", "p"), ("t", "e", "m", 2, "x", "g", None)]
    df = spark.createDataFrame(rows, PREDICTIONS)
    sinks.write_predictions(df, path)
    back = spark.read.parquet(path).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    plan = back.filter("dataset = 'e'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_json_arrays_are_bounded_in_bytes(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "repeat('x', 1000) AS instruction", "'y' AS output")
    path = str(tmp_path / "arrays")
    sinks.write_json_arrays(df, path, ["instruction", "output"], ["id"], bytes_per_file=5_000)
    files = [p for p in (tmp_path / "arrays").iterdir() if p.suffix == ".txt"]
    assert len(files) == 10 and max(p.stat().st_size for p in files) <= 5_000
    back = tables.read_json_array(spark, f"{path}/*.txt")
    assert back.count() == 40 and {r["position"] for r in back.collect()} == {0, 1, 2, 3}


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,prediction\nneg,0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("prediction,label\n1,pos\n", encoding="utf-8")
    rows, _ = lines.read_bare_csv(spark, str(tmp_path / "*.csv"), "label", "prediction")
    assert {(r["label"], r["prediction"]) for r in rows.collect()} == {("neg", "0"), ("pos", "1")}


def test_one_broken_file_does_not_stop_a_tree(spark, tmp_path):
    task = LabelTask("d", "r.csv", "results/d")
    bodies = {"base": "text,label,prediction\nhi,a,b\n", "f": '"text,label,prediction"\n"yo,c,d"\nno comma\n', "t": "text,label\nx,y\n",
              "u": "text,label,prediction\n"}
    for model, body in bodies.items():
        folder = tmp_path / "results/d" / model
        folder.mkdir(parents=True)
        (folder / "r.csv").write_text(body, encoding="utf-8")
    tree = tables.read_result_tree(spark, str(tmp_path), [task], {m: m for m in (*bodies, "v")})
    assert {(r["model"], r["text"], r["gold"], r["prediction"]) for r in tree.rows.collect()} == {("base", "hi", "a", "b"), ("f", "yo", "c", "d")}
    assert tree.missing == [("d", "v")] and [f.split("/")[-2] for f, _ in tree.skipped] == ["t"]
    nothing = tables.read_result_tree(spark, str(tmp_path / "none"), [task], {"base": "base"})
    assert nothing.rows.count() == 0 and nothing.missing == [("d", "base")]
