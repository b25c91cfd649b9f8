"""Text functions on hand-made strings."""

import pytest
from pyspark.sql import functions as F

from gradewell import registry
from gradewell.functions import text as tx


def values(spark, rows, *columns, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [row[0] if len(columns) == 1 else tuple(row) for row in df.select(*columns).collect()]


def test_whitespace_is_what_str_strip_removes():
    assert ("x" + tx.WHITESPACE).strip() == "x" and len(tx.WHITESPACE) == 29


CASES = [
    (tx.normalize_answer, "\t Good.\n", "good"),
    (tx.normalize_answer, "normal .", "normal "),
    (tx.normalize_answer, " ..Normal..　", "normal"),
    (tx.normalize_answer, "\x1c\x85 ok  ", "ok"),
    (tx.normalize_answer, None, None),
    (tx.letters_only, "It's a POSITIVE one", "itsapositiveone"),
    (tx.letters_only, "Été 9", "t"),
    (tx.letters_only, None, None),
    (tx.polarity, "positive, not negative", 1),
    (tx.polarity, "neg ative", 0),
    (tx.polarity, "fine", None),
    (tx.polarity, None, None),
    (lambda c: tx.polarity(c, ignore_spacing=False), "neg ative", None),
    (lambda c: tx.polarity(c, ignore_spacing=False), "NEGATIVE!", 0),
    (lambda c: tx.letters_only(c, null_as_text=True), None, "nan"),
    (lambda c: tx.match_label(c, ("bearish", "bullish", "neutral")), "bullish or bearish", "bearish"),
    (lambda c: tx.match_label(c, ("bearish", "bullish", "neutral")), " Bullish. ", "bullish"),
    (lambda c: tx.match_label(c, ("bearish", "bullish", "neutral")), None, "__invalid__"),
    (lambda c: tx.match_label(c, ("na", "x")), None, "na"),
    (lambda c: tx.resolve_or_wrong(c, F.lit("depression")), "no idea", "normal"),
    (lambda c: tx.resolve_or_wrong(c, F.lit("normal")), "no idea", "depression"),
    (lambda c: tx.resolve_or_wrong(c, F.lit("normal")), "abnormal", "normal"),
    (lambda c: tx.resolve_or_wrong(c, F.lit("normal")), "normal or Depression", "depression"),
    (lambda c: tx.resolve_or_wrong(c, F.lit("normal")), None, "depression"),
    (tx.normalize_prediction, " Invalid ", "invalid"),
    (tx.normalize_prediction, "Maybe depression?", "depression"),
    (tx.normalize_prediction, "Not Normal!", "normal"),
    (tx.normalize_prediction, "I can't say", "I can't say"),
    (tx.normalize_prediction, None, None),
    (tx.extract_option, "a dog", "A"),
    (tx.extract_option, "(b) or C", "B"),
    (tx.extract_option, "ABCD", None),
    (tx.extract_option, "éa Á", "A"),
    (tx.extract_option, "A_ 1B D", "D"),
    (tx.extract_option, None, None),
    (tx.extract_bool, "untrue", True),
    (tx.extract_bool, "it is FALSE", False),
    (tx.extract_bool, "no", None),
    (tx.extract_numbers, "$1,234.50 and -7", [1234.5, 7.0]),
    (tx.extract_numbers, "5. 1.2.3", [5.0, 1.2, 3.0]),
    (tx.extract_numbers, "٣٤ apples", [34.0]),
    (tx.extract_numbers, None, []),
    (lambda c: tx.extract_numbers(c, any_script=False), "٣ 4", [4.0]),
    (lambda c: tx.case_form(c, "capitalize"), " rISE up ", "Rise up"),
    (lambda c: tx.case_form(c, "upper"), " b\n", "B"),
    (lambda c: tx.case_form(c, "lower", null_as_text=True), None, "nan"),
    (tx.drop_answer_cue, "Is it? Answer：", "Is it?"),
    (tx.drop_answer_cue, " q ANSWER : \n", "q"),
    (tx.drop_answer_cue, "the answer", "the"),
    (tx.drop_answer_cue, "my answers", "my answers"),
    (tx.drop_answer_cue, "xanswer:", "xanswer:"),
    (tx.trimmed, None, ""),
    (tx.last_letter, " I pick B\n", "b"),
    (tx.last_letter, "", ""),
    (tx.last_letter, None, ""),
    (tx.after_marker, "User hi Assistant A b assistant C", "a b assistant c"),
    (tx.after_marker, " No Marker ", "No Marker"),
    (tx.is_error, "[Error] boom", True),
    (tx.is_error, None, False),
    (lambda c: tx.sibling_path(c, ".invalid.csv"), "a/b.csv", "a/b.invalid.csv"),
    (tx.dataset_of_file, "fiqasa_results.csv", "fiqasa"),
    (lambda c: tx.checked_label(c, ("positive", "mixed"), "mixed"), " Positive\n", "positive"),
    (lambda c: tx.checked_label(c, ("positive", "mixed"), "mixed"), "great", "mixed"),
    (lambda c: tx.checked_label(c, ("positive", "mixed"), "mixed"), None, "mixed"),
    (lambda c: tx.map_label(c, {"0": "neg"}), "1", None),
    (lambda c: tx.map_label(c, {"0": "neg"}, "__invalid__"), None, "__invalid__"),
    (lambda c: tx.map_label(c, {"0": "neg"}), "0", "neg"),
    (lambda c: tx.map_label(c, None), "raw", "raw"),
    (tx.null_tokens_to_null, "n/a", None),
    (tx.null_tokens_to_null, "nan ", "nan "),
    (lambda c: tx.contains_any(c, ("a", "b")), None, False),
    (lambda c: tx.contains_any(c, ()), "a", False),
    (lambda c: tx.first_nonblank(c, F.lit("z")), "", "z"),
    (lambda c: tx.chosen_value(c, F.lit("E"), F.lit("I")), "a", "E"),
    (lambda c: tx.chosen_value(c, F.lit("E"), F.lit("I")), "x", "I"),
]


def test_functions(spark):
    df = spark.createDataFrame([(1,)], "one int")
    columns = [fn(F.lit(given).cast("string")).alias(f"c{i}") for i, (fn, given, _) in enumerate(CASES)]
    row = df.select(*columns).first()
    assert [row[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


def test_functions_on_columns_match_literals(spark):
    """Not only constant folding: the same cases through a scan."""
    schema = ", ".join(f"s{i} string" for i in range(len(CASES)))
    df = spark.createDataFrame([tuple(given for _, given, _ in CASES)], schema).repartition(1)
    row = df.select(*[fn(f"s{i}").alias(f"c{i}") for i, (fn, _, _) in enumerate(CASES)]).first()
    assert [row[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


def test_ratio_and_smoothing(spark):
    row = spark.range(1).select(
        tx.ratio(F.lit(1), F.lit(0)), tx.ratio(F.lit(1), F.lit(4)), tx.ratio(F.lit(1), F.lit(0), None),
        tx.smoothed(F.lit(0.0)), tx.smoothed(F.lit(0.5)),
    ).first()
    assert tuple(row) == (0.0, 0.25, None, 1e-12, 0.5)


def test_prompts(spark):
    df = spark.createDataFrame(
        [("sst2", "  good film ", None), ("german_400", "Loan? Answer:", None), ("boolq", None, "p")],
        "dataset string, text string, passage string",
    ).withColumn("question", F.lit("q"))
    names = ("sst2", "german_400", "boolq")
    got = [r[0] for r in df.select(registry.prompt_by_dataset(names)).collect()]
    assert got[0].endswith("Sentence:\n  good film \n\nSentiment:") and got[0].startswith("You are a sentence-level")
    assert got[1] == "Loan?\n\nOnly respond with one word: good or bad. For example: good"
    assert got[2].endswith("Passage: p\n\nQuestion: q\n\nOnly respond with one word. like: true")
    other = spark.createDataFrame([("x", "plain")], "dataset string, text string")
    assert other.select(registry.prompt_by_dataset(["sst2"], fallback="text")).first()[0] == "plain"
    with pytest.raises(Exception, match="unsupported dataset: x"):
        other.select(registry.prompt_by_dataset(["sst2"])).collect()
    with pytest.raises(ValueError):
        registry.prompt_for("unknown")


def test_dimensions():
    assert registry.opposite_subtype("decision", "feeling") == "thinking"
    assert registry.dimension_of(3) == ("execution", "judging", "perceiving")
    with pytest.raises(ValueError):
        registry.opposite_subtype("decision", "sensing")
    with pytest.raises(ValueError):
        registry.opposite_subtype("mood", "x")
