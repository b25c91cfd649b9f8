"""User-level jobs over a predictions table."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions import text as tx
from gradewell.operators import distribution as dist
from gradewell.operators import metrics, repair, summary
from gradewell.registry import FINANCE_CASE, LABEL_TASKS, MARKET_CODES, MODELS, RELABEL, LabelTask, by_dataset
from gradewell.session import scratch_root

BY = ("dataset", "model")
MODEL_KEYS = tuple(MODELS)


def _drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows in which every parsed value is present."""
    return df.dropna(subset=list(columns))


# Parsers of the choice benchmarks; None stands for exact text, which has an accuracy only.
CHOICE_PARSERS: dict[str, Callable[[str], Column] | None] = {
    "ARC (easy)": tx.extract_option, "BoolQ": lambda c: tx.extract_bool(c).cast("string"), "GSM8K": None,
}


def _known_dataset(known: Sequence[str]) -> Column:
    """The dataset; a row of one that is not configured stops the job, so that none is lost in silence."""
    name = F.coalesce(F.col("dataset"), F.lit("null"))
    stop = F.raise_error(F.concat(F.lit("no rule for dataset "), name)).cast("string")
    return F.when(F.col("dataset").isin(list(known)), F.col("dataset")).otherwise(stop)


def score_choice_tasks(
    df: DataFrame, by: Sequence[str] = BY, null_as_text: bool = False,
    parsers: Mapping[str, Callable[[str], Column] | None] = CHOICE_PARSERS,
) -> DataFrame:
    """Options (ARC), booleans (BoolQ) and exact numbers (GSM8K); datasets without a parser raise."""
    gold, answer = (tx.strip(tx.as_text(side, null_as_text)) for side in ("gold", "prediction"))
    # Of exact text only the equality is counted, so no text is shuffled.
    exact = {"gold": F.when(gold.isNotNull(), "="), "prediction": F.when(answer == gold, "=").when(answer.isNotNull(), "/")}
    parsed = {
        side: by_dataset("dataset", {d: exact[side] if fn is None else fn(side) for d, fn in parsers.items()})
        for side in ("gold", "prediction")
    }
    rows = df.withColumns(parsed).withColumn("dataset", _known_dataset(list(parsers)))
    scored = metrics.macro_metrics(_drop_incomplete(rows, "gold", "prediction"), by)
    plain = [d for d, fn in parsers.items() if fn is None]
    only = {c: F.when(~F.col("dataset").isin(plain), F.col(c)).alias(c) for c in ("precision", "recall", "f1")}
    return scored.select(*by, "accuracy", *(only.values() if plain else only))


def score_finance_tasks(
    df: DataFrame, by: Sequence[str] = BY, cases: Mapping[str, str] = FINANCE_CASE, null_as_text: bool = False
) -> DataFrame:
    """Accuracy and macro F1 on answers in the case form of their dataset; other datasets raise."""
    df = df.withColumn("dataset", _known_dataset(list(cases)))
    for side in ("gold", "prediction"):
        forms = {d: tx.case_form(side, form, null_as_text) for d, form in cases.items()}
        df = df.withColumn(side, by_dataset("dataset", forms))
    out = metrics.macro_metrics(_drop_incomplete(df, "gold", "prediction"), by)
    return out.select(*by, "accuracy", "f1")


def score_polarity(df: DataFrame, by: Sequence[str] = BY, ignore_spacing: bool = True) -> DataFrame:
    """0/1 gold against the polarity word of the answer; a group without one has accuracy NaN."""
    parsed = df.withColumn("gold", F.col("gold").try_cast("int")).withColumn(
        "prediction", tx.polarity("prediction", ignore_spacing)
    )
    return metrics.binary_metrics(parsed, by, positive=1)


def score_market_sentiment(
    df: DataFrame, by: Sequence[str] = BY, codes: Mapping[str, str] = MARKET_CODES, null_as_text: bool = True
) -> DataFrame:
    """C4: coded gold against the label in the answer; unrecognised answers are counted, not scored."""
    parsed = df.withColumn("gold", tx.map_label("gold", codes, tx.INVALID)).withColumn(
        "prediction", tx.match_label("prediction", tuple(codes.values()), null_as_text)
    )
    out = metrics.macro_metrics(parsed, by, invalid=tx.INVALID)
    return out.select(*by, "accuracy", "f1", F.col("rows").alias("count"), F.col("invalid").alias("invalid_preds"))


def score_health_sentiment(
    df: DataFrame, by: Sequence[str] = BY, positive: str = "depression", negative: str = "normal"
) -> DataFrame:
    """An answer that names neither label always counts as wrong."""
    gold = tx.normalize_answer("gold", null_as_text=True)
    parsed = df.withColumn("gold", gold).withColumn(
        "resolved", tx.resolve_or_wrong("prediction", "gold", positive, negative)
    )
    return metrics.strict_metrics(parsed, by, positive=positive)


def score_numeric_answers(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The first number of the gold text must be among the numbers of the answer."""
    parsed = df.select(
        *by, tx.first_number("gold").alias("gold_number"), tx.extract_numbers("prediction").alias("pred_numbers")
    )
    return metrics.containment_accuracy(parsed, by)


def score_summaries(
    df: DataFrame,
    by: Sequence[str] = BY,
    reference: str = "reference",
    prediction: str = "prediction",
    stemmed: bool = False,
    vectors: tuple[str, str] | None = None,
    null_as_text: bool = False,
) -> DataFrame:
    """Mean ROUGE scores, and mean token-match scores where token vector columns are given."""
    columns = list(summary.ROUGE)
    scored = summary.with_rouge(df, reference, prediction, stemmed, null_as_text)
    if vectors:
        scored = summary.with_token_match(scored, *vectors)
        columns += ["match_precision", "match_recall", "match_f1"]
    return summary.mean_scores(scored, columns, by)


def label_sets(tasks: Sequence[LabelTask]) -> dict[str, list[str]]:
    """Cleaned allowed labels of the configured datasets."""
    return {t.name: sorted({re.sub("[^a-z]", "", n.lower()) for n in t.labels()}) for t in tasks if t.labels()}


def cleaned_labels(df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, null_as_text: bool = False) -> DataFrame:
    """P5, F2: gold mapped to label names and cleaned, and ``cleaned_prediction`` beside the raw answer."""
    gold = {t.name: tx.map_label("gold", t.label_map) for t in tasks}
    return df.withColumn("gold", tx.letters_only(by_dataset("dataset", gold), null_as_text)).withColumn(
        "cleaned_prediction", tx.letters_only("prediction", null_as_text)
    )


def _sets_for(tasks: Sequence[LabelTask]) -> tuple[dict[str, list[str]], list[str]]:
    """Configured label sets, and the datasets without one, which take their gold labels."""
    sets = label_sets(tasks)
    return sets, [t.name for t in tasks if t.name not in sets]


@dataclass(frozen=True)
class LabelAudit:
    """Label table (label by true, base, f, t) and the rows without a valid answer."""

    table: DataFrame
    invalid: DataFrame


def label_audit(
    df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, models: Sequence[str] = MODEL_KEYS,
    null_as_text: bool = False,
) -> LabelAudit:
    """Counts of labels contained in the answers, and invalid rows for S15."""
    cleaned = cleaned_labels(df, tasks, null_as_text)
    sets, bare = _sets_for(tasks)
    counts = dist.containment_counts(cleaned, sets, models, pred="cleaned_prediction", by_gold=bare)
    return LabelAudit(dist.wide_counts(counts, [dist.TRUE, *models]), _invalid(cleaned, tasks))


def _invalid(cleaned: DataFrame, tasks: Sequence[LabelTask]) -> DataFrame:
    """Rows of the configured datasets without a valid answer."""
    sets, bare = _sets_for(tasks)
    parts = [dist.invalid_rows(cleaned, sets)] if sets else []
    parts += [dist.invalid_by_gold(cleaned, bare)] if bare else []
    return reduce(DataFrame.unionByName, parts)


def repair_labels(
    df: DataFrame,
    labellers: Mapping[str, Callable[[], Callable[[str], str]]],
    tasks: Sequence[LabelTask] = LABEL_TASKS,
    models: Sequence[str] = MODEL_KEYS,
    relabel: Mapping[str, tuple[Sequence[str], Sequence[str], str]] = RELABEL,
    tidy: Sequence[str] = ("mental_sentiment",),
    corrections: DataFrame | None = None,
) -> DataFrame:
    """Find invalid answers, relabel them, merge the corrections by text, tidy, and return processed rows.

    ``labellers`` gives a labeller per dataset; ``corrections`` may hold labels made elsewhere, and these go before
    labellers' answers whatever their row numbers. The invalid rows are checkpointed with a digest of their text
    instead of the text, so rows are scanned once to find them and once to merge. Count the result with
    :func:`open_label_table`.
    """
    keys = ["dataset", "model", "row_id", "digest", "sentiment_label"]
    parts = []
    if labellers:
        scratch_root(df.sparkSession)
        digest = repair.text_digest("text").alias("digest")
        invalid = _invalid(cleaned_labels(df, tasks), tasks).select("dataset", "model", "row_id", digest, "prediction")
        parts.append(repair.label_unresolved(invalid.checkpoint(), labellers, relabel))
    if corrections is not None:
        parts.append(corrections.withColumn("digest", repair.text_digest("text")))
    if not parts:
        raise ValueError("give labellers, corrections or both")
    order = [F.struct(F.lit(i).alias("source"), "row_id").alias("row_id") for i in range(len(parts))]
    fixes = reduce(DataFrame.unionByName, [
        part.select(*keys).withColumn("row_id", o) for part, o in zip(parts, order)
    ])
    merged = repair.override_predictions(df, fixes)
    tidied = F.when(F.col("dataset").isin(list(tidy)), tx.normalize_prediction("prediction"))
    return merged.withColumn("prediction", tidied.otherwise(F.col("prediction")))


def open_label_counts(
    df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, models: Sequence[str] = MODEL_KEYS,
    null_as_text: bool = False,
) -> DataFrame:
    """Counts of every cleaned answer."""
    cleaned = cleaned_labels(df, tasks, null_as_text)
    sets, bare = _sets_for(tasks)
    return dist.open_counts(cleaned, sets, models, pred="cleaned_prediction", by_gold=bare)


def open_label_table(
    df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, models: Sequence[str] = MODEL_KEYS,
    null_as_text: bool = False,
) -> DataFrame:
    """C9, last step: R1 over A13."""
    return dist.wide_counts(open_label_counts(df, tasks, models, null_as_text), [dist.TRUE, *models])


def bias_report(
    df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, null_as_text: bool = False
) -> DataFrame:
    """Per label the shares, bias and scores over rows whose answer is a gold label."""
    pairs = dist.valid_confusion(cleaned_labels(df, tasks, null_as_text), pred="cleaned_prediction")
    report = metrics.label_report(pairs, gold="gold", pred="pred", weight="n")
    return dist.distribution_bias(pairs).join(report, ["dataset", "model", "label"], "left")


def bias_table(
    df: DataFrame, tasks: Sequence[LabelTask] = LABEL_TASKS, models: Sequence[str] = MODEL_KEYS,
    null_as_text: bool = False,
) -> DataFrame:
    """C10, allowed-label variant: the bias matrix label by model."""
    cleaned = cleaned_labels(df, tasks, null_as_text)
    sets, bare = _sets_for(tasks)
    counts = dist.exact_counts(cleaned, sets, models, pred="cleaned_prediction", by_gold=bare)
    return dist.allowed_bias(counts, models)


def distribution_report(counts: DataFrame, models: Sequence[str] = MODEL_KEYS, base: str = "base") -> DataFrame:
    """C11: per dataset and model the entropy, and the divergence from base (empty for base itself)."""
    h = dist.entropy(counts, models)
    return h.join(dist.kl_divergence(counts, models, base), ["dataset", "model"], "left")
