"""Scores of predicted against gold labels (A1 to A10).

Every function takes the grouping columns first, gives one row per group and leaves metrics unrounded.
Rows are combined before they are shuffled, so a label or model that holds most rows costs no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import ratio

BY = ("dataset", "model")


def confusion_counts(df: DataFrame, by: Sequence[str] = BY, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """A1: number of rows per (gold, prediction) pair."""
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(
    df: DataFrame,
    by: Sequence[str] = BY,
    gold: str = "gold",
    pred: str = "prediction",
    empty: float | None = 0.0,
) -> DataFrame:
    """A2: share of scored rows with equal labels; a row is scored when both sides are present."""
    scored = F.col(gold).isNotNull() & F.col(pred).isNotNull()
    return df.groupBy(*by).agg(
        ratio(F.count_if(scored & (F.col(gold) == F.col(pred))), F.count_if(scored), empty).alias("accuracy"),
        F.count_if(scored).alias("scored"),
    )


def binary_metrics(
    df: DataFrame,
    by: Sequence[str] = BY,
    gold: str = "gold",
    pred: str = "prediction",
    positive: int | str = 1,
    empty: float | None = float("nan"),
) -> DataFrame:
    """A3, A4: accuracy, precision, recall and F1 of one positive label over rows with a prediction.

    A group without any usable prediction stays in the result with ``empty`` accuracy and zeros.
    """
    scored = F.col(pred).isNotNull()
    is_gold, is_pred = F.col(gold) == F.lit(positive), F.col(pred) == F.lit(positive)
    counts = df.groupBy(*by).agg(
        F.count_if(scored & (F.col(gold) == F.col(pred))).alias("hits"),
        F.count_if(scored & is_gold & is_pred).alias("tp"),
        F.count_if(scored & is_pred).alias("pred_pos"),
        F.count_if(scored & is_gold).alias("gold_pos"),
        F.count_if(scored).alias("count"),
    )
    return counts.select(
        *by,
        ratio("hits", "count", empty).alias("accuracy"),
        ratio("tp", "pred_pos").alias("precision"),
        ratio("tp", "gold_pos").alias("recall"),
        ratio(2 * F.col("tp"), F.col("pred_pos") + F.col("gold_pos")).alias("f1"),
        "count",
    )


def _label_sums(df: DataFrame, by: Sequence[str], gold: str, pred: str, usable: Column, weight: str | None) -> DataFrame:
    """Per label: gold rows, predicted rows and hits. Unusable rows are counted under the null label.

    A hit emits one entry and a miss two, so one aggregate keyed by label replaces the two passes
    (gold side, predicted side) and the join between them.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    zero = F.lit(0).cast("long")

    def entry(label: Column, support: Column, predicted: Column, tp: Column, unusable: Column) -> Column:
        return F.struct(
            label.cast("string").alias("label"),
            support.alias("support"),
            predicted.alias("predicted"),
            tp.alias("tp"),
            unusable.alias("unusable"),
        )

    g, p = F.col(gold), F.col(pred)
    entries = (
        F.when(~usable, F.array(entry(F.lit(None), zero, zero, zero, w)))
        .when(g == p, F.array(entry(g, w, w, w, zero)))
        .otherwise(F.array(entry(g, w, zero, zero, zero), entry(p, zero, w, zero, zero)))
    )
    return (
        df.select(*by, F.explode(entries).alias("e"))
        .groupBy(*by, F.col("e.label").alias("label"))
        .agg(*[F.sum(f"e.{c}").alias(c) for c in ("support", "predicted", "tp", "unusable")])
    )


def _usable(gold: str, pred: str, invalid: str | None) -> Column:
    ok = F.col(gold).isNotNull() & F.col(pred).isNotNull()
    return ok & (F.col(pred) != invalid) if invalid is not None else ok


def _label_scores() -> list[Column]:
    return [
        ratio("tp", "predicted").alias("precision"),
        ratio("tp", "support").alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    ]


def label_report(
    df: DataFrame,
    by: Sequence[str] = BY,
    gold: str = "gold",
    pred: str = "prediction",
    invalid: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Precision, recall, F1 and support of every label in the union of gold and predictions."""
    sums = _label_sums(df, by, gold, pred, _usable(gold, pred, invalid), weight).filter("label is not null")
    return sums.select(*by, "label", *_label_scores(), "support")


def macro_metrics(
    df: DataFrame,
    by: Sequence[str] = BY,
    gold: str = "gold",
    pred: str = "prediction",
    invalid: str | None = None,
    empty: float | None = 0.0,
    weight: str | None = None,
) -> DataFrame:
    """A2, A5, A10 in one pass: accuracy, unweighted means over the label union, and row counts.

    ``invalid`` names a prediction that means "not recognised": such rows are counted, not scored.
    """
    sums = _label_sums(df, by, gold, pred, _usable(gold, pred, invalid), weight)
    scores = sums.select(
        *by, "support", "tp", "unusable", *[F.when(F.col("label").isNotNull(), c).alias(n)
                                            for c, n in zip(_label_scores(), ("precision", "recall", "f1"))]
    )
    out = scores.groupBy(*by).agg(
        ratio(F.sum("tp"), F.sum("support"), empty).alias("accuracy"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("scored"),
        F.sum("unusable").alias("invalid"),
    )
    return out.withColumn("rows", F.col("scored") + F.col("invalid"))


def strict_metrics(
    df: DataFrame, by: Sequence[str] = BY, gold: str = "gold", resolved: str = "resolved", positive: str = "depression"
) -> DataFrame:
    """Accuracy and F1 where an unreadable answer was already turned into the wrong label."""
    return binary_metrics(df, by, gold, resolved, positive, empty=0.0).select(*by, "accuracy", "f1", "count")


def containment_accuracy(
    df: DataFrame, by: Sequence[str] = BY, gold: str = "gold_number", pred: str = "pred_numbers"
) -> DataFrame:
    """Share of rows whose gold number is among the predicted numbers; rows lacking numbers are skipped."""
    scored = F.col(gold).isNotNull() & (F.size(pred) > 0)
    hit = scored & F.array_contains(F.col(pred), F.col(gold))
    return df.groupBy(*by).agg(
        ratio(F.count_if(hit), F.count_if(scored)).alias("accuracy"),
        F.count_if(hit).alias("correct"),
        F.count_if(scored).alias("total"),
    )


def exact_text_accuracy(df: DataFrame, by: Sequence[str] = BY, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """Accuracy on equal text; the other metrics stay empty."""
    nothing = F.lit(None).cast("double")
    return accuracy(df, by, gold, pred).select(
        *by, "accuracy", nothing.alias("precision"), nothing.alias("recall"), nothing.alias("f1")
    )


def row_counts(df: DataFrame, by: Sequence[str] = BY, pred: str = "prediction", invalid: str | None = None) -> DataFrame:
    """A10: rows, rows without a usable prediction, rows scored."""
    bad = F.col(pred).isNull()
    if invalid is not None:
        bad = bad | (F.col(pred) == invalid)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(bad).alias("invalid"),
        F.count_if(~bad).alias("scored"),
    )
