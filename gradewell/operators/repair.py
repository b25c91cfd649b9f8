"""Relabelling of unusable answers: routing, fallback labeller, and merging corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import as_text, checked_label, letters_only, strip
from gradewell.operators.scoring import paced
from gradewell.plans.skew import lookup_join
from gradewell.registry import by_dataset


def direct_label(pred: Column | str, known: Sequence[str]) -> Column:
    """The cleaned answer if it already is a known label, else null."""
    cleaned = letters_only(pred)
    return F.when(cleaned.isin(list(known)), cleaned)


def label_unresolved(
    invalid: DataFrame,
    labellers: Mapping[str, Callable[[], Callable[[str], str]]],
    relabel: Mapping[str, tuple[Sequence[str], Sequence[str], str]],
    pred: str = "prediction",
    pause: float = 0.0,
    partitions: int | None = None,
) -> DataFrame:
    """The invalid rows of the datasets in ``labellers``, with a ``sentiment_label``.

    ``relabel`` gives per dataset the known answers, the labels a labeller may return and the default. Known
    answers are copied. Each distinct other answer goes once through ``labellers[dataset]()`` in one batch job
    over all datasets, in as many partitions as a shuffle has (or ``partitions``) however few bytes the answers are;
    failures and unexpected labels become the default. The labels are checkpointed by the
    join that brings them back, so that no later action asks a slow or paid labeller again.
    """
    names = list(labellers)
    text = strip(as_text(pred, null_as_text=True))
    routed = invalid.filter(F.col("dataset").isin(names)).withColumn("_answer", text)
    direct = by_dataset("dataset", {d: direct_label("_answer", relabel[d][0]) for d in names})
    routed = routed.withColumn("_direct", direct)
    open_answers = routed.filter(F.col("_direct").isNull()).select("dataset", "_answer").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable[[str], str | None]] = {}
        for batch in batches:
            raw = []
            for dataset, answer in zip(batch["dataset"], batch["_answer"]):
                if dataset not in loaded:
                    loaded[dataset] = paced(labellers[dataset](), pause, on_error=lambda _: None)
                raw.append(loaded[dataset](answer))
            yield batch.assign(_raw=raw)

    # A repartition with a number is not merged by adaptive execution, so slow labellers work side by side.
    partitions = partitions or int(invalid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answered = open_answers.repartition(partitions, "dataset", "_answer").mapInPandas(run, "dataset string, _answer string, _raw string")
    label = by_dataset("dataset", {d: checked_label("_raw", *relabel[d][1:]) for d in names})
    answered = answered.select("dataset", "_answer", label.alias("_label"))
    joined = lookup_join(routed, answered, ["dataset", "_answer"])
    return joined.withColumn("sentiment_label", F.coalesce("_direct", "_label")).drop("_answer", "_direct", "_label")


def text_digest(text: Column | str) -> Column:
    """SHA-256 of a text as bytes; null for a missing text."""
    return F.unhex(F.sha2(text, 256))


def last_correction(
    corrections: DataFrame, key: Sequence[str], label: str = "sentiment_label", order: str = "row_id"
) -> DataFrame:
    """One correction per key, the last in row order; rows lacking key or label are dropped."""
    complete = corrections.dropna(subset=[*key, label])
    return complete.groupBy(*key).agg(F.max_by(label, order).alias(label))


def override_predictions(
    main: DataFrame,
    corrections: DataFrame,
    group: Sequence[str] = ("dataset", "model"),
    text: str = "text",
    pred: str = "prediction",
    label: str = "sentiment_label",
    order: str = "row_id",
    spread: Sequence[str] = ("dataset", "model", "row_id"),
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Every main row whose text was corrected gets the last correction, even rows that were valid.

    Rows are matched within ``group`` on the SHA-256 of the text: keys are short to sort, and the text itself
    is only moved where the caller keeps it. Corrections that have a ``digest`` need no text. Texts that many rows share are salted (``hot`` may name their key
    hashes if they are known already).
    """
    key = [*group, "_digest"]
    digest = text_digest(text)
    known = F.col("digest") if "digest" in corrections.columns else digest
    fixes = last_correction(
        corrections.select(*group, known.alias("_digest"), order, label), key, label, order
    ).withColumnRenamed(label, "_fix")
    joined = lookup_join(main.withColumn("_digest", digest), fixes, key, spread=list(spread), hot=hot)
    fixed = joined.withColumn(pred, F.coalesce(F.col("_fix").cast("string"), F.col(pred)))
    return fixed.select(*main.columns)


def override_rows(
    main: DataFrame,
    corrections: DataFrame,
    row_key: Sequence[str] = ("dataset", "model", "row_id"),
    pred: str = "prediction",
    label: str = "sentiment_label",
) -> DataFrame:
    """J1, strict form: only the corrected rows themselves change. Row keys are unique, so no key is hot."""
    fixes = corrections.dropna(subset=[label]).groupBy(*row_key).agg(F.max(label).alias("_fix"))
    joined = main.join(fixes, list(row_key), "left")
    return joined.withColumn(pred, F.coalesce("_fix", pred)).select(*main.columns)
