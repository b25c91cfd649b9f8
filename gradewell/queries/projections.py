"""Rows in, rows out."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.functions import text as tx
from gradewell.operators import corpus, metrics, preferences, repair
from gradewell.operators import distribution as dist
from gradewell.operators.scoring import for_models
from gradewell.plans import skew
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.registry import query
from gradewell.queries.scoring import _PARSED_MARKET, parsed_market
from gradewell.schema import require_columns


@query("P1_select_and_rename", "SELECT o_orderkey AS id, o_orderpriority AS label FROM orders")
def p1(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").withColumnsRenamed(
        {"o_orderkey": "id", "o_orderpriority": "label"}
    )


@query("P2_drop_column", "SELECT * EXCLUDE (doc_id) FROM documents")
def p2(spark, sf):
    return v.table(spark, sf, "documents").drop("doc_id")


@query("P3_membership_filter", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def p3(spark, sf):
    df = v.table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return df.select("o_orderkey", "o_orderpriority")


@query("P4_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def p4(spark, sf):
    return corpus.first_rows(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10000)


_CODE_SQL = "CASE gold WHEN '0' THEN 'bearish' WHEN '1' THEN 'bullish' WHEN '2' THEN 'neutral' {} END"
_CODES = {"0": "bearish", "1": "bullish", "2": "neutral"}


@query("P5_label_mapping", v.with_sql(v.MARKET_SQL, select=f"""
SELECT model, row_id, {_CODE_SQL.format('')} AS label FROM market"""))
def p5(spark, sf):
    return v.market(spark, sf).select("model", "row_id", tx.map_label("gold", _CODES).alias("label"))


@query("P6_label_mapping_default", v.with_sql(v.MARKET_SQL, select=f"""
SELECT model, row_id, {_CODE_SQL.format("ELSE '__invalid__'")} AS label FROM market"""))
def p6(spark, sf):
    return v.market(spark, sf).select("model", "row_id", tx.map_label("gold", _CODES, tx.INVALID).alias("label"))


@query("P7_append_prediction", v.with_sql(v.DIALOGUE_SQL, select="""
SELECT conv_id, turn, question, reply AS prediction FROM dialogue"""))
def p7(spark, sf):
    return v.dialogue(spark, sf).withColumn("prediction", F.col("reply")).drop("reply")


@query("P8_drop_unparsable", v.with_sql(v.CHOICES_SQL, f"""parsed AS (
  SELECT model, row_id, {q.option('gold')} AS gold, {q.option('prediction')} AS prediction
  FROM choices)""", select="""
SELECT * FROM parsed WHERE gold IS NOT NULL AND prediction IS NOT NULL"""))
def p8(spark, sf):
    df = v.choices(spark, sf).select(
        "model", "row_id", tx.extract_option("gold").alias("gold"), tx.extract_option("prediction").alias("prediction")
    )
    return df.dropna(subset=["gold", "prediction"])


_CLEAN_SQL = f"cleaned AS (SELECT *, {q.letters('prediction')} AS cleaned_prediction FROM answered)"
_VALID = "coalesce(contains(cleaned_prediction, 'positive') OR contains(cleaned_prediction, 'negative'), FALSE)"


def _cleaned(spark, sf):
    return v.answered_documents(spark, sf).withColumn("cleaned_prediction", tx.letters_only("prediction"))


_SETS = {lang: ["negative", "positive"] for lang in v.LANGS}


@query("P9_invalid_predictions", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, select=f"""
SELECT * FROM cleaned WHERE NOT {_VALID}"""))
def p9(spark, sf):
    return dist.invalid_rows(_cleaned(spark, sf), _SETS)


@query("P10_usable_predictions", v.with_sql(v.ANSWERED_SQL, select=f"""
SELECT dataset, model, row_id, gold, {q.polarity('prediction')} AS parsed FROM answered
WHERE {q.polarity('prediction')} IS NOT NULL"""))
def p10(spark, sf):
    df = v.answered_documents(spark, sf).select(
        "dataset", "model", "row_id", "gold", tx.polarity("prediction").alias("parsed")
    )
    return df.filter(F.col("parsed").isNotNull())


@query("P11_rows_with_numbers", v.with_sql(v.NUMBERS_SQL, select=f"""
SELECT dataset, model, gold, prediction FROM numbers
WHERE len({q.numbers('gold')}) > 0 AND len({q.numbers('prediction')}) > 0"""))
def p11(spark, sf):
    has = [F.size(tx.extract_numbers(c)) > 0 for c in ("gold", "prediction")]
    return v.numbers(spark, sf).filter(has[0] & has[1]).select("dataset", "model", "gold", "prediction")


def records(spark, sf):
    """Two instruction files: user turns (thinking) and assistant turns (feeling), numbered by their order."""
    turns = v.table(spark, sf, "conversations")
    parts = []
    for role, subtype in (("user", "thinking"), ("assistant", "feeling")):
        rows = skew.number_rows(turns.filter(F.col("role") == role), ["conv_id", "turn"])
        blank = (F.pmod("position", F.lit(7)) == 3) if role == "assistant" else (F.pmod("position", F.lit(11)) == 5)
        parts.append(
            rows.select(
                F.lit("decision").alias("dimension"), F.lit(subtype).alias("subtype"), "position",
                F.when(blank, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("instruction"),
                F.concat("role", F.lit(": "), "text", F.lit("\n")).alias("output"),
            )
        )
    return corpus.union_splits(*parts)


def _numbered(role: str, subtype: str, blank: str) -> str:
    return f"""SELECT 'decision' AS dimension, '{subtype}' AS subtype, position,
  CASE WHEN {blank} THEN '  ' ELSE ' ' || text END AS instruction, role || ': ' || text || chr(10) AS output
  FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM conversations WHERE role = '{role}')"""


RECORDS_SQL = f"""records AS ({_numbered('user', 'thinking', 'position % 11 = 5')}
  UNION ALL {_numbered('assistant', 'feeling', 'position % 7 = 3')})"""
PAIRED_SQL = f"""paired AS (
  SELECT a.position, {q.strip('a.instruction')} AS inst_a, {q.strip('a.output')} AS out_a,
         {q.strip('b.instruction')} AS inst_b, {q.strip('b.output')} AS out_b
  FROM records a JOIN records b ON a.position = b.position WHERE a.subtype = 'thinking' AND b.subtype = 'feeling'),
complete AS (SELECT * FROM paired WHERE inst_a <> '' AND out_a <> '' AND out_b <> '')"""


def _sides(spark, sf):
    raw = records(spark, sf)
    return [preferences.records_of(raw, "decision", s) for s in ("thinking", "feeling")]


@query("P12_complete_pairs", v.with_sql(RECORDS_SQL, PAIRED_SQL, select="SELECT * FROM complete"))
def p12(spark, sf):
    return preferences.complete_pairs(*_sides(spark, sf))


@query("P13_required_columns", "SELECT doc_id, text FROM documents")
def p13(spark, sf):
    return require_columns(v.table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "text")


@query("P14_direct_labels", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, select="""
SELECT model, row_id, CASE WHEN cleaned_prediction IN ('mixed', 'neutral') THEN cleaned_prediction END AS label
FROM cleaned"""))
def p14(spark, sf):
    return v.answered_documents(spark, sf).select(
        "model", "row_id", repair.direct_label("prediction", ("mixed", "neutral")).alias("label")
    )


@query("P15_only_ab_answers", f"""
SELECT doc_id, right(lower({q.strip('text')}), 1) AS answer FROM documents
WHERE right(lower({q.strip('text')}), 1) IN ('a', 'b')
UNION ALL
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END FROM documents""")
def p15(spark, sf):
    docs = v.table(spark, sf, "documents")
    said = F.concat("text", F.lit("\nSo: "), F.when(F.pmod("doc_id", F.lit(2)) == 0, "A ").otherwise("b"))
    texts = F.array(F.col("text"), said)
    answers = docs.select("doc_id", F.explode(texts).alias("t")).select("doc_id", tx.last_letter("t").alias("answer"))
    return answers.filter(F.col("answer").isin("a", "b"))


_FIXES = ("positive", "negative", "mixed", None)
_FIXES_SQL = f"""fixes AS (
  SELECT dataset, model, row_id, text, {v.pick_sql('row_id % 4', v.quoted(_FIXES))} AS sentiment_label
  FROM cleaned WHERE NOT {_VALID}),
last_fix AS (SELECT dataset, model, text, arg_max(sentiment_label, row_id) AS sentiment_label FROM fixes
  WHERE sentiment_label IS NOT NULL GROUP BY ALL)"""


def corrections(spark, sf):
    invalid = dist.invalid_rows(_cleaned(spark, sf), _SETS)
    return invalid.select(
        "dataset", "model", "row_id", "text", v.pick(F.pmod("row_id", F.lit(4)), _FIXES).alias("sentiment_label")
    )


@query("J1_override_join", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, _FIXES_SQL, select="""
SELECT a.dataset, a.model, a.row_id, coalesce(f.sentiment_label, a.prediction) AS prediction
FROM answered a LEFT JOIN last_fix f ON f.dataset = a.dataset AND f.model = a.model AND f.text = a.text"""))
def j1(spark, sf):
    out = repair.override_predictions(v.answered_documents(spark, sf), corrections(spark, sf))
    return out.select("dataset", "model", "row_id", "prediction")


@query("J1_override_strict", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, _FIXES_SQL, select="""
SELECT a.dataset, a.model, a.row_id, coalesce(f.sentiment_label, a.prediction) AS prediction
FROM answered a LEFT JOIN fixes f ON f.model = a.model AND f.row_id = a.row_id AND f.dataset = a.dataset"""))
def j1_strict(spark, sf):
    out = repair.override_rows(v.answered_documents(spark, sf), corrections(spark, sf))
    return out.select("dataset", "model", "row_id", "prediction")


@query("J2_semi_join_gold_labels", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT * FROM parsed p WHERE pred IN (SELECT gold FROM parsed g WHERE g.dataset = p.dataset AND g.model = p.model)"""))
def j2(spark, sf):
    return dist.rows_with_gold_label(parsed_market(spark, sf)).withColumnRenamed("prediction", "pred")


@query("J3_positional_zip", v.with_sql(RECORDS_SQL, select="""
SELECT a.position, a.output AS left_output, b.output AS right_output
FROM records a JOIN records b ON a.position = b.position WHERE a.subtype = 'thinking' AND b.subtype = 'feeling'"""))
def j3(spark, sf):
    a, b = _sides(spark, sf)
    return preferences.zip_by_position(
        a.select("position", F.col("output").alias("left_output")),
        b.select("position", F.col("output").alias("right_output")),
    )


@query("J4_chosen_rejected_lookup", v.with_sql(RECORDS_SQL, select="""
SELECT CASE subtype WHEN 'feeling' THEN 'chosen' ELSE 'rejected' END AS side, position, output FROM records"""))
def j4(spark, sf):
    chosen, rejected = preferences.chosen_and_rejected(records(spark, sf), "decision", "feeling")
    return corpus.union_splits(
        *[d.select(F.lit(side).alias("side"), "position", "output")
          for side, d in (("chosen", chosen), ("rejected", rejected))]
    )


@query("J5_grid_product", """
SELECT c_custkey, model FROM customer CROSS JOIN (VALUES ('base'), ('f'), ('t')) m(model)""")
def j5(spark, sf):
    return for_models(v.table(spark, sf, "customer").select("c_custkey"), v.MODEL_NAMES)


@query("J6_against_base", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, """counts AS (
  SELECT dataset, model, pred AS label, count(*) AS n FROM parsed GROUP BY ALL)""", select="""
SELECT b.dataset, b.label, m.model, b.n AS n_base, m.n AS n_model
FROM counts b JOIN counts m ON m.dataset = b.dataset AND m.label = b.label
WHERE b.model = 'base' AND m.model <> 'base'"""))
def j6(spark, sf):
    counts = parsed_market(spark, sf).groupBy(
        "dataset", F.col("model").alias("source"), F.col("prediction").alias("label")
    ).agg(F.count("*").alias("n"))
    return dist.against_base(counts, v.MODEL_NAMES)


@query("J7_complement_of_valid", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, select=f"""
SELECT dataset, model, row_id FROM cleaned EXCEPT SELECT dataset, model, row_id FROM cleaned WHERE {_VALID}"""))
def j7(spark, sf):
    valid = tx.contains_any("cleaned_prediction", ("negative", "positive"))
    return _cleaned(spark, sf).filter(~F.coalesce(valid, F.lit(False))).select("dataset", "model", "row_id")


@query("W4_last_duplicate_wins", v.with_sql(v.ANSWERED_SQL, _CLEAN_SQL, _FIXES_SQL, select="SELECT * FROM last_fix"))
def w4(spark, sf):
    return repair.last_correction(corrections(spark, sf), ["dataset", "model", "text"])


@query("W5_row_number", """
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS number FROM conversations""")
def w5(spark, sf):
    turns = v.table(spark, sf, "conversations").select("conv_id", "turn")
    return skew.number_rows(turns, ["conv_id", "turn"], "number", start=1)


@query("K1_sort_by_dataset", v.with_sql(v.MARKET_SQL, select="""
SELECT dataset, count(*) AS n FROM market GROUP BY dataset ORDER BY dataset"""))
def k1(spark, sf):
    return v.market(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).orderBy("dataset")


@query("K2_sort_by_label", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT dataset, pred AS label, count(*) AS n FROM parsed GROUP BY ALL ORDER BY dataset, label"""))
def k2(spark, sf):
    counts = metrics.confusion_counts(parsed_market(spark, sf), by=["dataset"])
    return counts.groupBy("dataset", F.col("pred").alias("label")).agg(F.sum("n").alias("n")).orderBy("dataset", "label")


@query("K4_head_per_dataset", """
SELECT event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3""")
def k4(spark, sf):
    events = v.table(spark, sf, "events").select("event_type", "event_id", "value")
    return corpus.head_per_group(events, ["event_type"], ["event_id"], 3)


@query("K5_union_splits", """
SELECT text, 'train' AS split FROM documents UNION ALL SELECT text, 'validation' FROM conversations
UNION ALL SELECT text, 'test' FROM benchmark""")
def k5(spark, sf):
    names = (("documents", "train"), ("conversations", "validation"), ("benchmark", "test"))
    return corpus.union_splits(*[v.table(spark, sf, t).select("text", F.lit(s).alias("split")) for t, s in names])


@query("K6_union_of_label_sets", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT dataset, model, gold AS label FROM parsed UNION SELECT dataset, model, pred FROM parsed"""))
def k6(spark, sf):
    parsed = parsed_market(spark, sf)
    sides = F.explode(F.array("gold", "prediction")).alias("label")
    return parsed.select("dataset", "model", sides).distinct()
