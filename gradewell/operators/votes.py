"""Votes over repeated questionnaire trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradewell.functions.text import after_marker, chosen_value, last_letter, ratio
from gradewell.operators.scoring import for_models
from gradewell.registry import AXES, LETTERS, NUM_TRIALS, STOP_COUNT, prompt_for


def questionnaire_prompts(questions: DataFrame, models: Sequence[str], trials: int = NUM_TRIALS) -> DataFrame:
    """Every question once per model and trial, with its prompt.

    ``questions`` has number, question and the structs choice_a and choice_b with text and value.
    """
    grid = for_models(questions, models).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    texts = {"text_a": F.col("choice_a.text"), "text_b": F.col("choice_b.text")}
    return grid.withColumns(texts).withColumn("prompt", prompt_for("questionnaire")).drop(*texts)


def chosen_letters(answers: DataFrame, answer: str = "prediction", keep_models: bool = False) -> DataFrame:
    """(model, trial, letter) for each answer whose last character is a or b.

    With ``keep_models`` other answers stay as rows without trial and letter, so that no model is lost.
    """
    given = answers.withColumn("_answer", last_letter(answer))
    usable = F.coalesce(F.col("_answer").isin("a", "b"), F.lit(False))
    letter = chosen_value("_answer", "choice_a.value", "choice_b.value")
    if not keep_models:
        return given.filter(usable).select("model", "trial", letter.alias("letter"))
    return given.select("model", F.when(usable, F.col("trial")).alias("trial"), F.when(usable, letter).alias("letter"))


def letter_tally(letters: DataFrame) -> DataFrame:
    """How often each of the eight letters was chosen in each trial."""
    names = list(LETTERS)
    return letters.groupBy("model", "trial").pivot("letter", names).count().fillna(0, names)


def trial_types(tally: DataFrame) -> DataFrame:
    """The four-letter type of each trial; a tie goes to the first letter of the axis."""
    return tally.select(
        "model", "trial",
        F.concat(*[F.when(F.col(a) >= F.col(b), a).otherwise(b) for a, b in AXES]).alias("type"),
    )


def running_counts(types: DataFrame) -> DataFrame:
    """How often each type has occurred up to and including each trial. One row per model and trial comes in."""
    window = W.partitionBy("model", "type").orderBy("trial").rowsBetween(W.unboundedPreceding, W.currentRow)
    return types.withColumn("running", F.count("*").over(window))


def counted_trials(types: DataFrame, stop_count: int = STOP_COUNT, cap: int | None = None) -> DataFrame:
    """Trials up to the first in which some type has been seen ``stop_count`` times.

    ``cap`` is the number of trials that are run at most; later ones, if there are any, do not count.
    """
    running = running_counts(types if cap is None else types.filter(F.coalesce(F.col("trial") <= cap, F.lit(True))))
    reached = F.min(F.when(F.col("running") >= stop_count, F.col("trial"))).over(W.partitionBy("model"))
    return (
        running.withColumn("_stop", reached)
        .filter(F.col("_stop").isNull() | (F.col("trial") <= F.col("_stop")))
        .select("model", "trial", "type")
    )


def type_counts(types: DataFrame) -> DataFrame:
    """Votes and first trial of each full type."""
    return types.groupBy("model", "type").agg(F.count("*").alias("n"), F.min("trial").alias("first"))


def axis_counts(types: DataFrame, whole: str | None = None) -> DataFrame:
    """Votes and first trial of each letter on its axis; ``whole`` adds the full type as one more axis."""
    letters = [F.struct(F.lit(f"{a}/{b}").alias("axis"), F.substring("type", i + 1, 1).alias("letter"))
               for i, (a, b) in enumerate(AXES)]
    if whole is not None:
        letters.append(F.struct(F.lit(whole).alias("axis"), F.col("type").alias("letter")))
    return (
        types.select("model", "trial", F.inline(F.array(*letters)))
        .groupBy("model", "axis", "letter")
        .agg(F.count("*").alias("n"), F.min("trial").alias("first"))
    )


def most_voted(counts: DataFrame, by: Sequence[str], what: str) -> DataFrame:
    """The entry with most votes, the first seen among equals."""
    best = F.max_by(F.col(what), F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(*by).agg(best.alias(what))


def vote(answers: DataFrame, answer: str = "prediction", stop_count: int = STOP_COUNT, cap: int | None = None) -> DataFrame:
    """C14: per model the most frequent type, the type made of the most frequent letters, and trials counted.

    Only the first ``cap`` trials count where a bound is given. ``answers`` has model, trial, the answer text and structs choice_a and choice_b with a ``value``.
    """
    # Unusable answers are one row per model without trial and type, so that one pass over the answers does.
    types = trial_types(letter_tally(chosen_letters(answers, answer, keep_models=True)))
    types = types.withColumn("type", F.when(F.col("trial").isNotNull(), F.col("type")))
    counts = axis_counts(counted_trials(types, stop_count, cap), whole="type")
    given = F.col("letter").isNotNull()
    best = counts.groupBy("model", "axis").agg(
        F.max_by(F.col("letter"), F.when(given, F.struct(F.col("n"), -F.col("first")))).alias("letter"),
        F.sum(F.when(given, F.col("n"))).alias("n"),
    )

    def on(axis: str, column: str) -> Column:
        return F.max(F.when(F.col("axis") == axis, F.col(column)))

    result = best.groupBy("model").agg(
        on("type", "letter").alias("type"),
        F.concat(*[on(f"{a}/{b}", "letter") for a, b in AXES]).alias("type_by_axis"),
        on("type", "n").alias("trials"),
    )
    return result.select(
        "model",
        F.coalesce("type", F.lit("N/A")).alias("type"),
        F.coalesce("type_by_axis", F.lit("?" * len(AXES))).alias("type_by_axis"),
        F.coalesce("trials", F.lit(0).cast("long")).alias("trials"),
    )


def both_orders(questions: DataFrame, first: str = "option_a", second: str = "option_b") -> DataFrame:
    """Each question with its two options in both orders."""
    orders = F.array(
        F.struct(F.lit("a,b").alias("order"), F.col(first).alias("option_1"), F.col(second).alias("option_2")),
        F.struct(F.lit("b,a").alias("order"), F.col(second).alias("option_1"), F.col(first).alias("option_2")),
    )
    return questions.select("*", F.inline(orders))


def order_effect(answers: DataFrame, by: Sequence[str] = ("model",), answer: str = "prediction") -> DataFrame:
    """Share of questions answered by position (same place, other content) when the options swap.

    ``answers`` has one row per question and order, with option_1, option_2 and the answer text.
    """
    said = F.lower(after_marker(answer))
    place: Column = F.when(said.contains(F.lower("option_1")), 1).when(said.contains(F.lower("option_2")), 2)
    swapped = (
        answers.withColumn("_place", place)
        .groupBy(*by, "question_id")
        .agg(
            F.max(F.when(F.col("order") == "a,b", F.col("_place"))).alias("_ab"),
            F.max(F.when(F.col("order") == "b,a", F.col("_place"))).alias("_ba"),
        )
    )
    both = F.col("_ab").isNotNull() & F.col("_ba").isNotNull()
    return swapped.groupBy(*by).agg(
        F.count_if(both).alias("answered"),
        F.count_if(both & (F.col("_ab") == F.col("_ba"))).alias("by_position"),
        ratio(F.count_if(both & (F.col("_ab") == F.col("_ba"))), F.count_if(both)).alias("position_share"),
    )
