"""Label counts, shares, bias, shift, entropy and divergence between models.

Count tables are long: ``(dataset, label, source, n)`` where source is ``true`` or a model. The step from
rows to counts is one combining aggregate over the whole predictions table; all that follows works on
counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import INVALID, contains_any, ratio
from gradewell.operators.automaton import find_labels, without_labels
from gradewell.operators.metrics import confusion_counts
from gradewell.plans.skew import group_total, lookup_join
from gradewell.session import scratch_root

LabelSets = Mapping[str, Sequence[str]]
TRUE = "true"


def is_allowed(label: Column | str, allowed: LabelSets, dataset: str = "dataset") -> Column:
    """True where the label belongs to the label set of the row's dataset."""
    label = F.col(label) if isinstance(label, str) else label
    tests = [(F.col(dataset) == name) & label.isin(list(names)) for name, names in allowed.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def gold_label_sets(df: DataFrame, gold: str = "gold") -> DataFrame:
    """The distinct gold labels of each dataset, one row per label."""
    return df.filter(F.col(gold).isNotNull()).select("dataset", F.col(gold).alias("label")).distinct()


def distinct_values(df: DataFrame, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """Distinct cleaned gold and predicted values per model, one row per value (sort when shown)."""
    sides = F.array(
        F.struct(F.lit("label").alias("side"), F.col(gold).cast("string").alias("value")),
        F.struct(F.lit("prediction").alias("side"), F.col(pred).cast("string").alias("value")),
    )
    return df.select("dataset", "model", F.inline(sides)).filter("value is not null").distinct()


def _model_rank(models: Sequence[str]) -> Column:
    out = F
    for rank, model in enumerate(models):
        out = out.when(F.col("model") == model, rank)
    return out.otherwise(len(models))


def _fixed(counts: DataFrame) -> DataFrame:
    """Counts checkpointed, so that whatever joins them with themselves scans the rows once."""
    scratch_root(counts.sparkSession)
    return counts.checkpoint()


def _gold_once(counts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Of the gold counts of all models, keep those of the first model each dataset has.

    The first model comes from the counts themselves. It is one row per dataset and joined as such.
    """
    first = counts.groupBy("dataset").agg(F.min(_model_rank(models)).alias("first"))
    return (
        counts.withColumn("rank", _model_rank(models))
        .join(first, "dataset")
        .filter((F.col("source") != TRUE) | (F.col("rank") == F.col("first")))
        .select("dataset", "label", "source", "n")
    )


def _side_counts(
    df: DataFrame, allowed: LabelSets, by_gold: Sequence[str], gold: str, pred: str, any_prediction: bool
) -> DataFrame:
    """Counts of both sides in one scan, checkpointed; null labels and labels that are not allowed are left out.

    Datasets in ``by_gold`` allow the gold labels they have, however many: a table that comes from the counts.
    """
    listed = list(allowed)
    named = {side: is_allowed(side, allowed) | F.col("dataset").isin(list(by_gold)) for side in (gold, pred)}
    sides = F.array(
        F.struct(F.lit(TRUE).alias("source"), F.when(named[gold], F.col(gold)).alias("label")),
        F.struct(F.col("model").alias("source"),
                 (F.col(pred) if any_prediction else F.when(named[pred], F.col(pred))).alias("label")),
    )
    counts = _fixed(
        df.filter(F.col("dataset").isin([*listed, *by_gold]))
        .select("dataset", "model", F.inline(sides))
        .filter("label is not null")
        .groupBy("dataset", "model", "source", "label")
        .agg(F.count("*").alias("n"))
    )
    if any_prediction or not by_gold:
        return counts
    golds = counts.filter(F.col("source") == TRUE).select("dataset", "label").distinct()
    return counts.filter(F.col("dataset").isin(listed)).unionByName(
        counts.filter(F.col("dataset").isin(list(by_gold))).join(golds, ["dataset", "label"], "left_semi")
    )


def exact_counts(
    df: DataFrame, allowed: LabelSets, models: Sequence[str], gold: str = "gold", pred: str = "prediction",
    by_gold: Sequence[str] = (),
) -> DataFrame:
    """Counts of gold and predicted labels, limited to allowed ones (``by_gold``: to the gold labels)."""
    return _gold_once(_side_counts(df, allowed, by_gold, gold, pred, False), models)


def open_counts(
    df: DataFrame, allowed: LabelSets, models: Sequence[str], gold: str = "gold", pred: str = "prediction",
    by_gold: Sequence[str] = (),
) -> DataFrame:
    """Counts of every predicted label, allowed or not; gold labels limited to allowed ones."""
    return _gold_once(_side_counts(df, allowed, by_gold, gold, pred, True), models)


def containment_counts(
    df: DataFrame, allowed: LabelSets, models: Sequence[str], gold: str = "gold", pred: str = "prediction",
    by_gold: Sequence[str] = (),
) -> DataFrame:
    """Per allowed label, predictions that contain it (a row may count under several) and gold rows.

    Configured sets: one conditional sum per distinct label word, so rows are neither multiplied nor shuffled as
    text. Datasets in ``by_gold`` allow their gold labels, however many, matched by :func:`containment_pairs`.
    """
    parts = []
    if allowed:
        words = sorted({word for names in allowed.values() for word in names})
        mine = {w: F.col("dataset").isin([d for d, names in allowed.items() if w in names]) for w in words}
        wide = df.filter(F.col("dataset").isin(list(allowed))).groupBy("dataset", "model").agg(
            *[F.count_if(mine[w] & F.col(pred).contains(w)).alias(f"p{i}") for i, w in enumerate(words)],
            *[F.count_if(mine[w] & (F.col(gold) == w)).alias(f"g{i}") for i, w in enumerate(words)],
        )
        entries = F.array(
            *[F.struct(F.col("model").alias("source"), F.lit(w).alias("label"), F.col(f"p{i}").alias("n"))
              for i, w in enumerate(words)],
            *[F.struct(F.lit(TRUE).alias("source"), F.lit(w).alias("label"), F.col(f"g{i}").alias("n"))
              for i, w in enumerate(words)],
        )
        parts.append(_fixed(wide.select("dataset", "model", F.inline(entries)).filter(is_allowed("label", allowed))))
    if by_gold:
        rows = df.filter(F.col("dataset").isin(list(by_gold)))
        golds = _fixed(
            rows.filter(F.col(gold).isNotNull()).groupBy("dataset", "model", F.col(gold).alias("label"))
            .agg(F.count("*").alias("n"))
        ).select("dataset", "model", F.lit(TRUE).alias("source"), "label", "n")
        found = containment_pairs(rows, golds.select("dataset", "label").distinct(), pred)
        parts.append(golds.unionByName(_fixed(found.withColumn("source", F.col("model")))))
    return _gold_once(reduce(DataFrame.unionByName, parts), models)


def containment_pairs(
    df: DataFrame, labels: DataFrame, pred: str = "prediction", by: Sequence[str] = ("dataset", "model")
) -> DataFrame:
    """A12 for label sets of any size: counts of (dataset, model, label), matched by one automaton of all labels.

    Texts are never shuffled; what is shuffled is one count per task and label found.
    """
    return find_labels(df, labels, pred, list(by)).groupBy(*by, "label").agg(F.count("*").alias("n"))


def invalid_rows(df: DataFrame, allowed: LabelSets, pred: str = "cleaned_prediction") -> DataFrame:
    """Rows of the datasets in ``allowed`` whose cleaned prediction contains none of their labels."""
    valid = [(F.col("dataset") == name) & contains_any(pred, names) for name, names in allowed.items()]
    unusable = ~F.coalesce(reduce(lambda a, b: a | b, valid), F.lit(False))
    return df.filter(F.col("dataset").isin(list(allowed)) & unusable)


def invalid_by_gold(df: DataFrame, datasets: Sequence[str], gold: str = "gold", pred: str = "cleaned_prediction") -> DataFrame:
    """P9 for datasets whose label set is their gold labels (A22), however many."""
    rows = df.filter(F.col("dataset").isin(list(datasets)))
    return without_labels(rows, gold_label_sets(rows, gold), pred)


def rows_with_gold_label(df: DataFrame, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """Rows whose prediction occurs among the gold labels of the same dataset and model."""
    labels = df.filter(F.col(gold).isNotNull()).select("dataset", "model", F.col(gold).alias("_label")).distinct()
    renamed = df.withColumn("_label", F.col(pred))
    return lookup_join(renamed, labels, ["dataset", "model", "_label"], "left_semi").drop("_label")


def valid_pairs(confusion: DataFrame) -> DataFrame:
    """J2 on confusion counts: pairs whose prediction is a gold label of the same dataset and model."""
    labels = confusion.groupBy("dataset", "model", F.col("gold").alias("pred")).agg(F.sum("n").alias("_rows"))
    labels = labels.filter("pred is not null and _rows > 0").drop("_rows")
    return confusion.join(labels, ["dataset", "model", "pred"], "left_semi")


def valid_confusion(df: DataFrame, gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """Confusion counts over rows whose prediction is a gold label of their dataset and model.

    The counts are checkpointed, so both sides of the semi join come from one scan in any plan.
    """
    rows = df.filter(F.col(gold).isNotNull()).withColumn(pred, F.coalesce(F.col(pred), F.lit(INVALID)))
    return valid_pairs(_fixed(confusion_counts(rows, ("dataset", "model"), gold, pred)))


def distribution_bias(pairs: DataFrame) -> DataFrame:
    """Predicted and true share of every label over the valid pairs, and their difference."""
    n = F.col("n")
    entries = F.array(
        F.struct(F.col("gold").alias("label"), n.alias("true_n"), F.lit(0).cast("long").alias("pred_n")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("true_n"), n.alias("pred_n")),
    )
    labels = (
        pairs.select("dataset", "model", F.inline(entries))
        .groupBy("dataset", "model", "label")
        .agg(F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"))
    )
    shares = group_total(labels, ["dataset", "model"], "true_n").select(
        "dataset", "model", "label",
        ratio("pred_n", "total").alias("pred_ratio"),
        ratio("true_n", "total").alias("true_ratio"),
    )
    return shares.withColumn("bias", F.col("pred_ratio") - F.col("true_ratio"))


def wide_counts(counts: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("dataset", "label")) -> DataFrame:
    """One row per label, one zero-filled column per source."""
    return counts.groupBy(*keys).pivot("source", list(sources)).agg(F.sum("n")).fillna(0, list(sources))


def allowed_bias(counts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Predicted share over allowed-label counts (at least 1) minus true share, per model column."""
    wide = wide_counts(counts, [TRUE, *models])
    totals = wide.groupBy("dataset").agg(*[F.sum(c).alias(f"_{c}") for c in (TRUE, *models)])
    true_share = ratio(TRUE, f"_{TRUE}", None)
    return wide.join(totals, "dataset").select(
        "dataset", "label",
        *[(ratio(m, F.greatest(F.col(f"_{m}"), F.lit(1)), None) - true_share).alias(m) for m in models],
    )


def against_base(counts: DataFrame, models: Sequence[str], base: str = "base") -> DataFrame:
    """Each model's count of a label beside the base model's; a label a model lacks counts zero."""
    others = [m for m in models if m != base]
    wide = wide_counts(counts.filter(F.col("source").isin(list(models))), models)
    return wide.select(
        "dataset", "label", F.col(base).alias("n_base"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("n_model")) for m in others])),
    )


def relative_shift(counts: DataFrame, models: Sequence[str], base: str = "base", places: int | None = None) -> DataFrame:
    """Change of a label's count against the base model, in per cent; null where base has none."""
    shift = ratio((F.col("n_model") - F.col("n_base")) * 100, "n_base", None)
    shift = F.round(shift, places) if places is not None else shift
    return against_base(counts, models, base).select("dataset", "label", "model", shift.alias("shift"))


def entropy(counts: DataFrame, models: Sequence[str], unit: str = "bits", epsilon: float = 1e-12) -> DataFrame:
    """Entropy of each model's label distribution on the label grid of the dataset.

    Zero shares become epsilon and are not renormalised. With T rows and counts n,
    -sum(n/T log n/T) = log T - sum(n log n) / T, so one aggregate gives it without first joining totals.
    """
    log = F.log2 if unit == "bits" else F.ln
    grid = wide_counts(counts.filter(F.col("source").isin(list(models))), models)
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("n")) for m in models])
    n = F.col("n")
    sums = (
        grid.select("dataset", F.inline(cells))
        .groupBy("dataset", "model")
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(n > 0, n * log(n)).otherwise(F.lit(0.0))).alias("n_log_n"),
            F.count_if(n == 0).alias("zeros"),
        )
    )
    eps = F.lit(epsilon)
    value = log(F.col("total")) - F.col("n_log_n") / F.col("total") - F.col("zeros") * eps * log(eps)
    return sums.select("dataset", "model", F.when(F.col("total") > 0, value).alias("entropy"))


def kl_divergence(counts: DataFrame, models: Sequence[str], base: str = "base", epsilon: float = 1e-12) -> DataFrame:
    """Divergence in bits of each model's label distribution from the base model's.

    sum q log2(q / p) with q = n_model / T_model, p = n_base / T_base, zero shares set to epsilon. The sum is
    split by which of the two counts is zero, so that totals enter only at the end of one aggregate.
    """
    q, p = F.col("n_model").cast("double"), F.col("n_base").cast("double")
    eps, zero = F.lit(epsilon), F.lit(0.0)
    log_eps = F.log2(eps)
    both, only_q, only_p = (q > 0) & (p > 0), (q > 0) & (p == 0), (q == 0) & (p > 0)
    sums = (
        against_base(counts, models, base)
        .groupBy("dataset", "model")
        .agg(
            F.sum(q).alias("tq"),
            F.sum(p).alias("tp"),
            F.sum(F.when(both, q * (F.log2(q) - F.log2(p))).otherwise(zero)).alias("both_sum"),
            F.sum(F.when(both, q).otherwise(zero)).alias("both_n"),
            F.sum(F.when(only_q, q * F.log2(q)).otherwise(zero)).alias("q_sum"),
            F.sum(F.when(only_q, q).otherwise(zero)).alias("q_n"),
            F.sum(F.when(only_p, F.log2(p)).otherwise(zero)).alias("p_log"),
            F.count_if(only_p).alias("p_zeros"),
        )
    )
    tq, tp = F.col("tq"), F.col("tp")
    value = (
        (F.col("both_sum") + F.col("both_n") * (F.log2(tp) - F.log2(tq))) / tq
        + (F.col("q_sum") - F.col("q_n") * (F.log2(tq) + log_eps)) / tq
        + eps * (F.col("p_zeros") * (log_eps + F.log2(tp)) - F.col("p_log"))
    )
    return sums.select("dataset", "model", F.when((tq > 0) & (tp > 0), value).alias("kl"))


def collapse_invalid(counts: DataFrame, classes: LabelSets, name: str = "invalid") -> DataFrame:
    """Labels outside the class set of their dataset are summed into ``invalid``."""
    label = F.when(is_allowed("label", classes), F.col("label")).otherwise(F.lit(name))
    return counts.groupBy("dataset", "source", label.alias("label")).agg(F.sum("n").alias("n"))


def share_of_total(counts: DataFrame, by: Sequence[str] = ("dataset", "source"), value: str = "n") -> DataFrame:
    """Share of each label in its group, in per cent."""
    return group_total(counts, by, value).withColumn("share", ratio(F.col(value) * 100, "total")).drop("total")


def wide_metrics(bias: DataFrame, report: DataFrame, labels: Sequence[str]) -> DataFrame:
    """R2: one row per dataset and model with the bias and score columns of every named label."""
    joined = bias.join(report, ["dataset", "model", "label"], "left")
    columns = []
    for label in labels:
        here = F.col("label") == label
        for source, name in (("pred_ratio", f"Pred_{label}_ratio"), ("true_ratio", f"True_{label}_ratio"),
                             ("bias", f"Bias_{label}"), ("precision", f"{label}_precision"),
                             ("recall", f"{label}_recall"), ("f1", f"{label}_f1-score"),
                             ("support", f"{label}_support")):
            columns.append(F.max(F.when(here, F.col(source))).alias(name))
    return joined.groupBy("dataset", "model").agg(*columns)


def transpose_models(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per dataset one row per metric and one column per model."""
    metrics = [c for c in wide.columns if c not in ("dataset", "model")]
    doubles = wide.select("dataset", "model", *[F.col(f"`{c}`").cast("double").alias(c) for c in metrics])
    long = doubles.unpivot(["dataset", "model"], [F.col(f"`{c}`") for c in metrics], "metric", "value")
    return long.groupBy("dataset", "metric").pivot("model", list(models)).agg(F.max("value"))
