"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import text as tx
from gradewell.operators import metrics
from gradewell.plans import jobs
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.registry import query
from gradewell.registry import FINANCE_CASE, by_dataset

_PARSED_REVIEWS = f"""parsed AS (
  SELECT dataset, model, CAST(gold AS INTEGER) AS gold, {q.polarity('prediction')} AS pred FROM reviews)"""
_CODES = ("bearish", "bullish", "neutral")
_PARSED_MARKET = f"""parsed AS (
  SELECT dataset, model,
         CASE gold WHEN '0' THEN 'bearish' WHEN '1' THEN 'bullish' WHEN '2' THEN 'neutral' ELSE '__invalid__' END AS gold,
         {q.match('prediction', _CODES)} AS pred FROM market),
scored AS (SELECT * FROM parsed WHERE pred <> '__invalid__')"""
_PARSED_FINANCE = f"""parsed AS (
  SELECT dataset, model, {q.finance_form('gold')} AS gold, {q.finance_form('prediction')} AS pred FROM finance),
scored AS (SELECT * FROM parsed WHERE gold IS NOT NULL AND pred IS NOT NULL)"""
_PARSED_HEALTH = f"""parsed AS (
  SELECT dataset, model, {q.normalize('gold')} AS gold, prediction FROM health),
resolved AS (SELECT dataset, model, gold, {q.resolve('prediction', 'gold')} AS pred FROM parsed)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Both engines sum in their own order; six places make results comparable."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _parsed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return v.reviews(spark, sf).select(
        "dataset", "model", F.col("gold").cast("int").alias("gold"), tx.polarity("prediction").alias("prediction")
    )


def _parsed_finance(spark: SparkSession, sf: str) -> DataFrame:
    df = v.finance(spark, sf)
    for side in ("gold", "prediction"):
        df = df.withColumn(side, by_dataset("dataset", {d: tx.case_form(side, f) for d, f in FINANCE_CASE.items()}))
    return df


def parsed_market(spark: SparkSession, sf: str) -> DataFrame:
    codes = {"0": "bearish", "1": "bullish", "2": "neutral"}
    return v.market(spark, sf).select(
        "dataset", "model", tx.map_label("gold", codes, tx.INVALID).alias("gold"),
        tx.match_label("prediction", _CODES).alias("prediction"),
    )


@query("A1_confusion_counts", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT dataset, model, gold, pred, count(*) AS n FROM parsed GROUP BY ALL"""))
def a1(spark, sf):
    return metrics.confusion_counts(parsed_market(spark, sf))


@query("A2_accuracy", v.with_sql(v.FINANCE_SQL, _PARSED_FINANCE, select="""
SELECT dataset, model, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS scored
FROM scored GROUP BY ALL"""))
def a2(spark, sf):
    return rounded(metrics.accuracy(_parsed_finance(spark, sf)), "accuracy")


_BINARY = f"""SELECT {{by}}, round(CASE WHEN count(pred) = 0 THEN 'nan'::DOUBLE ELSE
         CAST(count(*) FILTER (gold = pred) AS DOUBLE) / count(pred) END, 6) AS accuracy,
       round({q.div("count(*) FILTER (gold = {pos} AND pred = {pos})", "count(*) FILTER (pred = {pos})")}, 6) AS precision,
       round({q.div("count(*) FILTER (gold = {pos} AND pred = {pos})", "count(*) FILTER (gold = {pos} AND pred IS NOT NULL)")}, 6) AS recall,
       round({q.div("2 * count(*) FILTER (gold = {pos} AND pred = {pos})",
                    "count(*) FILTER (pred = {pos}) + count(*) FILTER (gold = {pos} AND pred IS NOT NULL)")}, 6) AS f1,
       count(pred) AS count
FROM {{source}} GROUP BY {{by}}"""


def _binary(pos: str, source: str, by: str = "dataset, model") -> str:
    return _BINARY.replace("{pos}", pos).replace("{by}", by).replace("{source}", source)


@query("A3_binary_metrics", v.with_sql(v.REVIEWS_SQL, _PARSED_REVIEWS, select=_binary("1", "parsed")))
def a3(spark, sf):
    return rounded(metrics.binary_metrics(_parsed_reviews(spark, sf)), "accuracy", "precision", "recall", "f1")


@query("A4_binary_named_positive", v.with_sql(v.HEALTH_SQL, _PARSED_HEALTH,
                                              select=_binary("'depression'", "resolved")))
def a4(spark, sf):
    df = v.health(spark, sf).withColumn("gold", tx.normalize_answer("gold"))
    df = df.withColumn("prediction", tx.resolve_or_wrong("prediction", "gold"))
    return rounded(metrics.binary_metrics(df, positive="depression"), "accuracy", "precision", "recall", "f1")


@query("A5_macro_metrics", v.with_sql(v.FINANCE_SQL, _PARSED_FINANCE, q.macro("scored"), select="""
SELECT dataset, model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, scored FROM macro"""))
def a5(spark, sf):
    out = metrics.macro_metrics(_parsed_finance(spark, sf)).drop("invalid", "rows")
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query("A6_label_report", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, q.macro("scored"), select="""
SELECT dataset, model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM label_scores"""))
def a6(spark, sf):
    return rounded(metrics.label_report(parsed_market(spark, sf), invalid=tx.INVALID), "precision", "recall", "f1")


@query("A7_strict_wrong_accuracy", v.with_sql(v.HEALTH_SQL, _PARSED_HEALTH, select=f"""
SELECT dataset, model, accuracy, f1, count FROM ({_binary("'depression'", "resolved")})"""))
def a7(spark, sf):
    df = v.health(spark, sf).withColumn("gold", tx.normalize_answer("gold"))
    df = df.withColumn("resolved", tx.resolve_or_wrong("prediction", "gold"))
    return rounded(metrics.strict_metrics(df), "accuracy", "f1")


_NUMERIC = f"""nums AS (SELECT dataset, model, {q.numbers('gold')} AS g, {q.numbers('prediction')} AS p FROM numbers),
hits AS (SELECT dataset, model, list_contains(p, g[1]) AS hit FROM nums WHERE len(g) > 0 AND len(p) > 0)"""


@query("A8_containment_accuracy", v.with_sql(v.NUMBERS_SQL, _NUMERIC, select="""
SELECT dataset, model, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) FILTER (hit) AS correct, count(*) AS total FROM hits GROUP BY ALL"""))
def a8(spark, sf):
    df = v.numbers(spark, sf).select(
        "dataset", "model", tx.first_number("gold").alias("gold_number"),
        tx.extract_numbers("prediction").alias("pred_numbers"),
    )
    return rounded(metrics.containment_accuracy(df), "accuracy")


@query("A9_exact_text_accuracy", v.with_sql(v.CHOICES_SQL, select=f"""
SELECT dataset, model, round(avg(CASE WHEN {q.strip('gold')} = {q.strip('prediction')} THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1
FROM choices WHERE prediction IS NOT NULL GROUP BY ALL"""))
def a9(spark, sf):
    df = v.choices(spark, sf).withColumns({"gold": tx.strip("gold"), "prediction": tx.strip("prediction")})
    return rounded(metrics.exact_text_accuracy(df), "accuracy")


@query("A10_row_counts", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT dataset, model, count(*) AS rows, count(*) FILTER (pred = '__invalid__') AS invalid,
       count(*) FILTER (pred <> '__invalid__') AS scored FROM parsed GROUP BY ALL"""))
def a10(spark, sf):
    return metrics.row_counts(parsed_market(spark, sf), invalid=tx.INVALID)


_PARSED_CHOICES = f"""parsed AS (
  SELECT dataset, model,
         CASE dataset WHEN 'ARC (easy)' THEN {q.option('gold')} ELSE CAST({q.boolean('gold')} AS VARCHAR) END AS gold,
         CASE dataset WHEN 'ARC (easy)' THEN {q.option('prediction')}
              ELSE CAST({q.boolean('prediction')} AS VARCHAR) END AS pred
  FROM choices WHERE dataset <> 'GSM8K'),
scored AS (SELECT * FROM parsed WHERE gold IS NOT NULL AND pred IS NOT NULL)"""


@query("C1_score_choice_tasks", v.with_sql(v.CHOICES_SQL, _PARSED_CHOICES, q.macro("scored"), select=f"""
SELECT dataset, model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM macro
UNION ALL
SELECT dataset, model, round(avg(CASE WHEN {q.strip('gold')} = {q.strip('prediction')} THEN 1.0 ELSE 0.0 END), 6),
       NULL, NULL, NULL
FROM choices WHERE dataset = 'GSM8K' AND prediction IS NOT NULL GROUP BY dataset, model"""))
def c1(spark, sf):
    return rounded(jobs.score_choice_tasks(v.choices(spark, sf)), "accuracy", "precision", "recall", "f1")


@query("C2_score_finance_tasks", v.with_sql(v.FINANCE_SQL, _PARSED_FINANCE, q.macro("scored"), select="""
SELECT dataset, model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM macro"""))
def c2(spark, sf):
    return rounded(jobs.score_finance_tasks(v.finance(spark, sf)), "accuracy", "f1")


@query("C2_score_finance_tasks_null_as_text", v.with_sql(
    v.FINANCE_SQL.replace("finance AS", "finance_raw AS", 1),
    "finance AS (SELECT * REPLACE (coalesce(prediction, 'nan') AS prediction, coalesce(gold, 'nan') AS gold) FROM finance_raw)",
    _PARSED_FINANCE, q.macro("scored"), select="""
SELECT dataset, model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM macro"""))
def c2_parity(spark, sf):
    return rounded(jobs.score_finance_tasks(v.finance(spark, sf), null_as_text=True), "accuracy", "f1")


@query("C3_score_polarity", v.with_sql(v.REVIEWS_SQL, _PARSED_REVIEWS, select=_binary("1", "parsed", "model")))
def c3(spark, sf):
    return rounded(jobs.score_polarity(v.reviews(spark, sf), ["model"]), "accuracy", "precision", "recall", "f1")


@query("C4_score_market_sentiment", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, q.macro("scored"), """counts AS (
  SELECT dataset, model, count(*) AS count, count(*) FILTER (pred = '__invalid__') AS invalid_preds
  FROM parsed GROUP BY ALL)""", select="""
SELECT c.dataset, c.model, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(f1, 0), 6) AS f1, count,
       invalid_preds FROM counts c LEFT JOIN macro m ON m.dataset = c.dataset AND m.model = c.model"""))
def c4(spark, sf):
    return rounded(jobs.score_market_sentiment(v.market(spark, sf)), "accuracy", "f1")


@query("C5_score_health_sentiment", v.with_sql(v.HEALTH_SQL, _PARSED_HEALTH, select=f"""
SELECT model, accuracy, f1, count FROM ({_binary("'depression'", "resolved", "model")})"""))
def c5(spark, sf):
    return rounded(jobs.score_health_sentiment(v.health(spark, sf), ["model"]), "accuracy", "f1")


@query("C6_score_numeric_answers", v.with_sql(v.NUMBERS_SQL, _NUMERIC, select="""
SELECT model, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) FILTER (hit) AS correct, count(*) AS total FROM hits GROUP BY ALL"""))
def c6(spark, sf):
    return rounded(jobs.score_numeric_answers(v.numbers(spark, sf), ["model"]), "accuracy")
