"""From result files to the corrected label table, through files only."""

from gradewell import registry
from gradewell.plans import jobs
from gradewell.registry import MODELS
from gradewell.schema import INPUTS, QUESTION
from gradewell.session import scratch_path
from gradewell.sources import sinks, tables

TASK = registry.LABEL_TASKS[0]


def put(root, model, suffix, header, rows):
    folder = root / TASK.base_path / MODELS[model]
    folder.mkdir(parents=True, exist_ok=True)
    body = "".join(",".join(r) + "\n" for r in rows)
    (folder / TASK.file.replace(".csv", suffix)).write_text(f"{header}\n{body}", encoding="utf-8")


def test_audit_correct_and_recount(spark, tmp_path):
    header = "text,label,prediction"
    put(tmp_path, "base", ".csv", header, [("t1", "1", "Positive"), ("t2", "0", "mixed"), ("t2", "0", "negative"), ("t3", "0", "")])
    put(tmp_path, "f", ".csv", header, [("t1", "1", "negative positive"), ("t2", "0", "who knows")])
    put(tmp_path, "base", registry.CORRECTION_SUFFIX[TASK.name], header + ",cleaned_prediction,sentiment_label",
        [("t2", "0", "mixed", "mixed", "neutral"), ("t2", "0", "mixed", "mixed", "mixed"), ("t3", "0", "", "", "")])
    schema = INPUTS["text_label"]
    rows = tables.read_results(spark, str(tmp_path), TASK, MODELS, schema)
    audit = jobs.label_audit(rows, [TASK])
    assert {r["label"]: (r["true"], r["base"], r["f"], r["t"]) for r in audit.table.collect()} == {
        "negative": (3, 1, 1, 0), "positive": (1, 1, 1, 0)}
    path = scratch_path(spark, "flow")
    sinks.write_invalid(audit.invalid.select("row_id", "text", "prediction", "cleaned_prediction", "dataset", "model"), path)
    back = spark.read.option("header", True).csv(path)
    assert {(r["model"], r["text"]) for r in back.collect()} == {("base", "t2"), ("base", "t3"), ("f", "t2")}

    fixes = tables.read_results(spark, str(tmp_path), registry.sibling(TASK, registry.CORRECTION_SUFFIX[TASK.name]), MODELS,
                                schema, extra=("cleaned_prediction", "sentiment_label"))
    processed = jobs.repair_labels(rows, {}, [TASK], corrections=fixes)
    got = {(r["model"], r["text"], r["prediction"]) for r in processed.collect()}
    # The last correction of a text wins and also replaces its valid row.
    assert got == {("base", "t1", "Positive"), ("base", "t2", "mixed"), ("base", "t3", None),
                   ("f", "t1", "negative positive"), ("f", "t2", "who knows")}
    table = {r["label"]: (r["true"], r["base"], r["f"]) for r in jobs.open_label_table(processed, [TASK]).collect()}
    assert table == {"negative": (3, 0, 0), "positive": (1, 1, 0), "mixed": (0, 2, 0), "negativepositive": (0, 0, 1),
                     "whoknows": (0, 0, 1)}


def test_questionnaire_file(spark, tmp_path):
    import json

    from gradewell.operators import votes

    items = [{"question": "Q?", "choice_a": {"text": "yes", "value": "E"}, "choice_b": {"text": "no", "value": "I"}},
             {"question": "R?", "choice_a": {"text": "y", "value": "S"}, "choice_b": {"text": "n", "value": "N"}}]
    (tmp_path / "q.json").write_text(json.dumps(items))
    questions = tables.read_json_array(spark, str(tmp_path / "q.json"), QUESTION)
    numbered = questions.withColumn("number", questions["position"] + 1)
    grid = votes.questionnaire_prompts(numbered, ["m"], trials=3)
    assert grid.count() == 6
    first = grid.filter("number = 2 and trial = 1").first()
    assert first["prompt"].endswith("or 'b'.\n\nQ2: R?\nA: y (a)\nB: n (b)")
    answered = grid.selectExpr("*", "if(number = 1, 'A', 'the b') as prediction")
    assert tuple(votes.vote(answered).first()) == ("m", "ENTJ", "ENTJ", 3)
