"""Predictions derived from the star-schema tables, once as DataFrames and once as SQL.

No table holds model answers, so answers are chosen by arithmetic on row keys (``WHEN`` lists below, the
same in both languages) and every row of the source table takes part. Three models use different
multipliers, so they agree on some rows and differ on others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.plans.jobs import CHOICE_PARSERS
from gradewell.registry import FINANCE_CASE, LabelTask

MODELS = (("base", 3, 0), ("f", 7, 1), ("t", 1, 4))
MODEL_NAMES = tuple(m for m, _, _ in MODELS)
MODELS_SQL = "(VALUES ('base', 3, 0), ('f', 7, 1), ('t', 1, 4)) m(model, k, c)"

LANGS = ("de", "en", "es", "fr")
POLARITY = {"0": "negative", "1": "positive"}
REVIEW_TASKS = tuple(LabelTask(lang, f"{lang}_results.csv", f"results/{lang}", POLARITY) for lang in LANGS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_model(df: DataFrame) -> DataFrame:
    """Each row once per model, with the model's multiplier k and offset c."""
    models = ", ".join(f"named_struct('model', '{m}', 'k', {k}, 'c', {c})" for m, k, c in MODELS)
    return df.select("*", F.expr(f"inline(array({models}))"))


def pick(index: Column, answers: Sequence[Column | str | None]) -> Column:
    """The answer at ``index``; None stands for a missing one."""
    columns = [a if isinstance(a, Column) else F.lit(a).cast("string") for a in answers]
    return F.elt(index.cast("int") + 1, *columns)


def pick_expr(index: str, answers: Sequence[str | None]) -> str:
    """The same as Spark SQL text, for lists of SQL expressions; one string is quicker to build than many columns."""
    return f"elt(cast({index} as int) + 1, " + ", ".join("cast(null as string)" if a is None else a for a in answers) + ")"


def pick_sql(index: str, answers: Sequence[str | None]) -> str:
    """The same as SQL; entries are SQL expressions, None is NULL."""
    return f"CASE {index} " + " ".join(
        f"WHEN {i} THEN {'NULL' if a is None else a}" for i, a in enumerate(answers)
    ) + " END"


def quoted(answers: Sequence[str | None]) -> list[str | None]:
    return [None if a is None else "'" + a.replace("'", "''") + "'" for a in answers]


# --- reviews: labels x documents, 0/1 gold, dataset = language ---------------------------------
REVIEW_ANSWERS = ("Positive", " negative.", "positive", "NEGATIVE", "mixed", "neutral",
                  "It is positive, not negative", None, "n/a", "[Error] x")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "text")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return per_model(rows).selectExpr(
        "'polarity' as task", "dataset", "model", "doc_id as row_id", "text", "cast(quality as string) as gold",
        pick_expr("(doc_id * k + c) % 10", quoted(REVIEW_ANSWERS)) + " as prediction",
    )


REVIEWS_SQL = f"""reviews AS (
  SELECT 'polarity' AS task, d.lang AS dataset, m.model, l.doc_id AS row_id, d.text AS text,
         CAST(l.quality AS VARCHAR) AS gold,
         {pick_sql('(l.doc_id * m.k + m.c) % 10', quoted(REVIEW_ANSWERS))} AS prediction
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN {MODELS_SQL})"""

# --- market: events, coded gold (code 3 is unknown), dataset = event type ----------------------
MARKET_ANSWERS = ("Bearish", "bullish.", " Neutral ", "it looks bullish or bearish", "unsure", None, "NEUTRAL",
                  "bearish .", "Bullish!")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return per_model(events).selectExpr(
        "'market' as task", "event_type as dataset", "model", "event_id as row_id", "cast(user_id % 4 as string) as gold",
        pick_expr("(event_id * k + user_id + c) % 9", quoted(MARKET_ANSWERS)) + " as prediction",
    )


MARKET_SQL = f"""market AS (
  SELECT 'market' AS task, e.event_type AS dataset, m.model, e.event_id AS row_id,
         CAST(e.user_id % 4 AS VARCHAR) AS gold,
         {pick_sql('(e.event_id * m.k + e.user_id + m.c) % 9', quoted(MARKET_ANSWERS))} AS prediction
  FROM events e CROSS JOIN {MODELS_SQL})"""

# --- health: orders, dataset = order priority --------------------------------------------------
HEALTH_ANSWERS = ("Normal", "depression.", "I feel abnormal", "severe Depression today", None, "no idea", " NORMAL ",
                  "Unwell")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return per_model(orders).selectExpr(
        "'health' as task", "o_orderpriority as dataset", "model", "o_orderkey as row_id",
        "case when o_orderstatus = 'F' then ' Normal.' else 'Depression' end as gold",
        pick_expr("(o_orderkey * k + c) % 8", quoted(HEALTH_ANSWERS)) + " as prediction",
    )


HEALTH_SQL = f"""health AS (
  SELECT 'health' AS task, o.o_orderpriority AS dataset, m.model, o.o_orderkey AS row_id,
         CASE WHEN o.o_orderstatus = 'F' THEN ' Normal.' ELSE 'Depression' END AS gold,
         {pick_sql('(o.o_orderkey * m.k + m.c) % 8', quoted(HEALTH_ANSWERS))} AS prediction
  FROM orders o CROSS JOIN {MODELS_SQL})"""

# --- finance: parts, five datasets, some answers are free text ---------------------------------
FINANCE = tuple(zip(FINANCE_CASE, (
    ("A", "B", "C"), ("positive", "negative", "neutral"), ("good", "bad", "good"), ("Rise", "Fall", "rise"), ("Yes", "No", "yes"),
)))


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    golds = [pick_expr("p_partkey % 3", quoted(a)) for _, a in FINANCE]
    guesses = [pick_expr("(p_partkey * k + c) % 5", [*quoted((f" {a[0]} ", a[1].upper(), a[2].lower())), "p_name", None])
               for _, a in FINANCE]
    return per_model(parts).selectExpr(
        "'finance' as task", pick_expr("p_size % 5", quoted([name for name, _ in FINANCE])) + " as dataset", "model",
        "p_partkey as row_id", pick_expr("p_size % 5", golds) + " as gold",
        pick_expr("p_size % 5", guesses) + " as prediction",
    )


FINANCE_SQL = f"""finance AS (
  SELECT 'finance' AS task, {pick_sql('p.p_size % 5', quoted([n for n, _ in FINANCE]))} AS dataset, m.model,
         p.p_partkey AS row_id,
         {pick_sql('p.p_size % 5', [pick_sql('p.p_partkey % 3', quoted(a)) for _, a in FINANCE])} AS gold,
         {pick_sql('p.p_size % 5', [pick_sql('(p.p_partkey * m.k + m.c) % 5',
          [*quoted((f' {a[0]} ', a[1].upper(), a[2].lower())), 'p.p_name', None]) for _, a in FINANCE])} AS prediction
  FROM part p CROSS JOIN {MODELS_SQL})"""

# --- choices: customers, three benchmark datasets ----------------------------------------------
CHOICE_DATASETS = tuple(CHOICE_PARSERS)
LETTERS = ("A", "B", "C", "D")
CHOICE_ANSWERS = (
    ("a dog", "The answer is B.", "c)", "D", "AB", None),
    ("True", "that is untrue", "FALSE.", "maybe", "it is false or true", None),
    ("7", " 8 ", "nine", "12.0", "7", None),
)
CHOICE_GOLD = (LETTERS, ("true", "False", "TRUE", "false"), ("7", "8 ", "12", "9"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    which = "c_nationkey % 3"
    return per_model(rows).selectExpr(
        "'choice' as task", pick_expr(which, quoted(CHOICE_DATASETS)) + " as dataset", "model", "c_custkey as row_id",
        pick_expr(which, [pick_expr("c_custkey % 4", quoted(g)) for g in CHOICE_GOLD]) + " as gold",
        pick_expr(which, [pick_expr("(c_custkey * k + c) % 6", quoted(a)) for a in CHOICE_ANSWERS]) + " as prediction",
    )


CHOICES_SQL = f"""choices AS (
  SELECT 'choice' AS task, {pick_sql('u.c_nationkey % 3', quoted(CHOICE_DATASETS))} AS dataset, m.model,
         u.c_custkey AS row_id,
         {pick_sql('u.c_nationkey % 3', [pick_sql('u.c_custkey % 4', quoted(g)) for g in CHOICE_GOLD])} AS gold,
         {pick_sql('u.c_nationkey % 3', [pick_sql('(u.c_custkey * m.k + m.c) % 6', quoted(a))
          for a in CHOICE_ANSWERS])} AS prediction
  FROM customer u CROSS JOIN {MODELS_SQL})"""

# --- numbers: line items, dataset = return flag ------------------------------------------------


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    rows = rows.selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "cast(l_quantity as bigint) as qty")
    answers = ("concat('about $1,234.50 and ', qty)", "concat('-', qty)", "'no number'", "cast(qty + 1 as string)", None,
               "concat(qty, '.')")
    return per_model(rows).selectExpr(
        "'numbers' as task", "l_returnflag as dataset", "model",
        "case when qty = 13 then 'unknown' else concat('#### ', qty) end as gold",
        pick_expr("(l_orderkey * k + l_linenumber + c) % 6", answers) + " as prediction",
    )


_QTY = "CAST(i.l_quantity AS BIGINT)"
NUMBERS_SQL = f"""numbers AS (
  SELECT 'numbers' AS task, i.l_returnflag AS dataset, m.model,
         CASE WHEN {_QTY} = 13 THEN 'unknown' ELSE '#### ' || CAST({_QTY} AS VARCHAR) END AS gold,
         {pick_sql('(i.l_orderkey * m.k + i.l_linenumber + m.c) % 6', [
             f"'about $1,234.50 and ' || CAST({_QTY} AS VARCHAR)", f"'-' || CAST({_QTY} AS VARCHAR)", "'no number'",
             f"CAST({_QTY} + 1 AS VARCHAR)", None, f"CAST({_QTY} AS VARCHAR) || '.'"])} AS prediction
  FROM lineitem i CROSS JOIN {MODELS_SQL})"""

# --- dialogue: a user turn and the assistant turn after it -------------------------------------


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, reply); the key is unique, so the join is even however long a conversation is."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replies, ["conv_id", "turn"])


DIALOGUE_SQL = """dialogue AS (
  SELECT q.conv_id, q.turn, q.text AS question, r.text AS reply
  FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1
  WHERE q.role = 'user' AND r.role = 'assistant')"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary pairs: the question is the reference; the models answer with the reply, the
    reply and the question, and the question twice."""
    prediction = (
        F.when(F.col("model") == "base", F.col("reply"))
        .when(F.col("model") == "f", F.concat("reply", F.lit("\n"), "question"))
        .otherwise(F.concat("question", F.lit(" "), "question"))
    )
    return per_model(dialogue(spark, sf_dir)).select(
        F.lit("dialogue").alias("dataset"), "model", "conv_id", "turn",
        F.col("question").alias("reference"), prediction.alias("prediction"),
    )


SUMMARIES_SQL = f"""{DIALOGUE_SQL}, summaries AS (
  SELECT 'dialogue' AS dataset, m.model, conv_id, turn, question AS reference,
         CASE m.model WHEN 'base' THEN reply WHEN 'f' THEN reply || chr(10) || question
              ELSE question || ' ' || question END AS prediction
  FROM dialogue CROSS JOIN {MODELS_SQL})"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- every document answered by every model, keyed by its text (copies share a key) -------------


def answered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "text")
    return per_model(docs).selectExpr(
        "'documents' as task", "dataset", "model", "doc_id as row_id", "text", "cast(doc_id % 2 as string) as gold",
        pick_expr("(doc_id * k + c) % 10", quoted(REVIEW_ANSWERS)) + " as prediction",
    )


ANSWERED_SQL = f"""answered AS (
  SELECT 'documents' AS task, d.lang AS dataset, m.model, d.doc_id AS row_id, d.text AS text,
         CAST(d.doc_id % 2 AS VARCHAR) AS gold,
         {pick_sql('(d.doc_id * m.k + m.c) % 10', quoted(REVIEW_ANSWERS))} AS prediction
  FROM documents d CROSS JOIN {MODELS_SQL})"""
