"""F1 to F24 and the function forms U3 to U6, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell import registry
from gradewell.functions import text as tx
from gradewell.operators import distribution as dist
from gradewell.operators import preferences
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.registry import query
from gradewell.queries.scoring import parsed_market, rounded


def _docs(spark, sf):
    return v.table(spark, sf, "documents")


# Text with white space of several kinds and a dot around it.
def _padded(c="text"):
    return F.concat(F.lit("\t "), F.col(c), F.lit(" .　\n"))


_PADDED = "(chr(9) || chr(160) || text || ' .' || chr(12288) || chr(10))"


@query("F1_normalize_answer", f"SELECT doc_id, {q.normalize(_PADDED)} AS cleaned FROM documents")
def f1(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalize_answer(_padded()).alias("cleaned"))


@query("F2_letters_only", f"SELECT doc_id, {q.letters('text')} AS cleaned FROM documents")
def f2(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.letters_only("text").alias("cleaned"))


@query("F3_polarity_by_word", v.with_sql(v.ANSWERED_SQL, select=f"""
SELECT model, row_id, {q.polarity('prediction')} AS letters_variant,
       CASE WHEN contains(lower(prediction), 'positive') THEN 1
            WHEN contains(lower(prediction), 'negative') THEN 0 END AS plain_variant FROM answered"""))
def f3(spark, sf):
    return v.answered_documents(spark, sf).select(
        "model", "row_id", tx.polarity("prediction").alias("letters_variant"),
        tx.polarity("prediction", ignore_spacing=False).alias("plain_variant"),
    )


_WORDS = ("the", "der", "les", "and")


@query("F4_match_label", f"SELECT doc_id, {q.match('text', _WORDS)} AS label FROM documents")
def f4(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.match_label("text", _WORDS).alias("label"))


@query("F5_resolve_or_wrong", v.with_sql(v.HEALTH_SQL, select=f"""
SELECT model, row_id, {q.resolve('prediction', q.normalize('gold'))} AS label FROM health"""))
def f5(spark, sf):
    df = v.health(spark, sf).withColumn("gold", tx.normalize_answer("gold"))
    return df.select("model", "row_id", tx.resolve_or_wrong("prediction", "gold").alias("label"))


_TIDY = f"""CASE WHEN regexp_matches(lower({q.strip('prediction')}), '^[a-z]+$') THEN lower({q.strip('prediction')})
       WHEN contains(lower(prediction), 'depression') THEN 'depression'
       WHEN contains(lower(prediction), 'normal') THEN 'normal' ELSE prediction END"""


@query("F6_normalize_prediction", v.with_sql(v.HEALTH_SQL, select=f"SELECT model, row_id, {_TIDY} AS label FROM health"))
def f6(spark, sf):
    return v.health(spark, sf).select("model", "row_id", tx.normalize_prediction("prediction").alias("label"))


@query("F7_extract_option", f"""
SELECT doc_id, {q.option('text')} AS letter, {q.option("source || ' (' || lang || ') c'")} AS constructed FROM documents""")
def f7(spark, sf):
    made = F.concat("source", F.lit(" ("), "lang", F.lit(") c"))
    return _docs(spark, sf).select(
        "doc_id", tx.extract_option("text").alias("letter"), tx.extract_option(made).alias("constructed")
    )


@query("F8_extract_bool", v.with_sql(v.CHOICES_SQL, select=f"""
SELECT model, row_id, {q.boolean('prediction')} AS answer, {q.boolean('gold')} AS expected FROM choices"""))
def f8(spark, sf):
    return v.choices(spark, sf).select(
        "model", "row_id", tx.extract_bool("prediction").alias("answer"), tx.extract_bool("gold").alias("expected")
    )


@query("F9_extract_numbers", f"""
SELECT page_id, {q.numbers('html')} AS numbers, {q.numbers("url || ' costs $1,0' || page_id || '.50'")} AS prices
FROM pages""")
def f9(spark, sf):
    price = F.concat("url", F.lit(" costs $1,0"), F.col("page_id").cast("string"), F.lit(".50"))
    return v.table(spark, sf, "pages").select(
        "page_id", tx.extract_numbers("html").alias("numbers"), tx.extract_numbers(price).alias("prices")
    )


@query("F10_case_forms", v.with_sql(v.FINANCE_SQL, select=f"""
SELECT model, row_id, upper({q.strip('prediction')}) AS up, lower({q.strip('prediction')}) AS low,
       {q.capitalized('prediction')} AS cap FROM finance"""))
def f10(spark, sf):
    return v.finance(spark, sf).select(
        "model", "row_id",
        *[tx.case_form("prediction", f).alias(n) for f, n in (("upper", "up"), ("lower", "low"), ("capitalize", "cap"))],
    )


_CUES = (" Answer:", "\nANSWER ： ", " answers", "")


def _cue_end():
    return F.concat("text", v.pick(F.pmod("doc_id", F.lit(4)), _CUES))


_CUE_END = "(text || " + v.pick_sql("doc_id % 4", ["' Answer:'", "chr(10) || 'ANSWER ： '", "' answers'", "''"]) + ")"
_DROP_CUE = q.strip(f"regexp_replace({q.strip(_CUE_END)}, '(?i)\\banswer\\s*[:：]?\\s*$', '')")


@query("F11_drop_answer_cue", f"SELECT doc_id, {_DROP_CUE} AS cleaned FROM documents")
def f11(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.drop_answer_cue(_cue_end()).alias("cleaned"))


_PROMPTED = ("german_400", "cfa_1000", "fiqasa_bench", "bigdata_1400", "headlines_2000", "other")


def _prompt_sql(name: str) -> str:
    if name == "other":
        return "text"
    before, after = registry.PROMPTS[name].split("{text}")
    return f"{v.quoted([before])[0]} || cleaned || {v.quoted([after])[0]}"


@query("F12_prompt_by_dataset", f"""
SELECT doc_id, {v.pick_sql('doc_id % 6', [_prompt_sql(n) for n in _PROMPTED])} AS prompt
FROM (SELECT doc_id, {_CUE_END} AS text, {_DROP_CUE} AS cleaned FROM documents)""")
def f12(spark, sf):
    dataset = v.pick(F.pmod("doc_id", F.lit(6)), _PROMPTED)
    df = _docs(spark, sf).select("doc_id", dataset.alias("dataset"), _cue_end().alias("text"))
    return df.select("doc_id", registry.prompt_by_dataset(_PROMPTED[:-1], fallback="text").alias("prompt"))


@query("F13_chat_json", v.with_sql(v.DIALOGUE_SQL, select="""
SELECT conv_id, turn, CAST(to_json([{'role': 'user', 'content': question}, {'role': 'assistant', 'content': reply}])
  AS VARCHAR) AS chat FROM dialogue"""))
def f13(spark, sf):
    return v.dialogue(spark, sf).select("conv_id", "turn", preferences.chat_json("question", "reply").alias("chat"))


@query("F14_trim_and_default", f"""
SELECT conv_id, turn, {q.strip("coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE chr(8195) || text || ' ' END, '')")} AS text
FROM conversations""")
def f14(spark, sf):
    padded = F.when(F.pmod("turn", F.lit(3)) != 0, F.concat(F.lit(" "), "text", F.lit(" ")))
    return v.table(spark, sf, "conversations").select("conv_id", "turn", tx.trimmed(padded).alias("text"))


@query("F15_first_nonblank", v.with_sql(v.DIALOGUE_SQL, select="""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN question ELSE reply END AS text FROM dialogue"""))
def f15(spark, sf):
    first = F.when(F.pmod("turn", F.lit(2)) == 0, F.col("question")).otherwise("")
    return v.dialogue(spark, sf).select("conv_id", "turn", tx.first_nonblank(first, "reply").alias("text"))


@query("F16_last_letter", f"SELECT doc_id, right(lower({q.strip('text')}), 1) AS letter FROM documents")
def f16(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.last_letter("text").alias("letter"))


@query("F17_chosen_value", """
SELECT p_partkey, CASE WHEN CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END = 'a' THEN p_brand ELSE p_type END AS value
FROM part""")
def f17(spark, sf):
    answer = F.when(F.pmod("p_size", F.lit(3)) == 0, "a").otherwise("b")
    return v.table(spark, sf, "part").select("p_partkey", tx.chosen_value(answer, "p_brand", "p_type").alias("value"))


_TALK = "CASE WHEN turn % 2 = 0 THEN 'User ' || question || chr(10) || 'Assistant' || chr(10) || reply ELSE reply END"


@query("F18_after_marker", v.with_sql(v.DIALOGUE_SQL, f"talk AS (SELECT conv_id, turn, {_TALK} AS text FROM dialogue)",
                                      select=f"""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'assistant')
  THEN {q.strip("substr(lower(text), instr(lower(text), 'assistant') + 9)")} ELSE {q.strip('text')} END AS answer FROM talk"""))
def f18(spark, sf):
    talk = F.concat(F.lit("User "), "question", F.lit("\nAssistant\n"), "reply")
    text = F.when(F.pmod("turn", F.lit(2)) == 0, talk).otherwise(F.col("reply"))
    return v.dialogue(spark, sf).select("conv_id", "turn", tx.after_marker(text).alias("answer"))


@query("F19_error_rate", v.with_sql(v.ANSWERED_SQL, select="""
SELECT dataset, model, count(*) FILTER (prediction LIKE '[Error]%') AS errors,
       round(avg(CASE WHEN prediction LIKE '[Error]%' THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM answered GROUP BY ALL"""))
def f19(spark, sf):
    error = tx.is_error("prediction")
    out = v.answered_documents(spark, sf).groupBy("dataset", "model").agg(
        F.count_if(error).alias("errors"), F.avg(error.cast("double")).alias("error_rate")
    )
    return rounded(out, "error_rate")


@query("F20_path_edits", """
SELECT doc_id, source || '/' || lang || '_results.invalid.csv' AS invalid, source || '/' || lang || '_results.processed.csv'
  AS processed, lang AS dataset FROM documents""")
def f20(spark, sf):
    path = F.concat("source", F.lit("/"), "lang", F.lit("_results.csv"))
    return _docs(spark, sf).select(
        "doc_id", tx.sibling_path(path, ".invalid.csv").alias("invalid"),
        tx.sibling_path(path, ".processed.csv").alias("processed"),
        tx.dataset_of_file(F.concat("lang", F.lit("_results.csv"))).alias("dataset"),
    )


@query("F21_presentation_rounding", """
SELECT o_orderkey, round(o_totalprice / 7, 4) AS r4, round(o_totalprice / 7, 5) AS r5, round(o_totalprice / 7, 6) AS r6
FROM orders""")
def f21(spark, sf):
    value = F.col("o_totalprice") / 7
    return v.table(spark, sf, "orders").select(
        "o_orderkey", *[tx.presentation(value, n).alias(f"r{n}") for n in (4, 5, 6)]
    )


@query("F22_smoothed_logs", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(log2(CASE WHEN l_discount = 0 THEN 1e-12 ELSE l_discount END), 6) AS bits,
       round(ln(CASE WHEN l_tax = 0 THEN 1e-12 ELSE l_tax END), 6) AS nats FROM lineitem""")
def f22(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.log2(tx.smoothed("l_discount")), 6).alias("bits"), F.round(F.ln(tx.smoothed("l_tax")), 6).alias("nats"),
    )


@query("F23_checked_label", v.with_sql(v.ANSWERED_SQL, select=f"""
SELECT model, row_id, CASE WHEN lower({q.strip('prediction')}) IN ('positive', 'negative', 'mixed')
  THEN lower({q.strip('prediction')}) ELSE 'mixed' END AS label FROM answered"""))
def f23(spark, sf):
    return v.answered_documents(spark, sf).select(
        "model", "row_id", tx.checked_label("prediction", ("positive", "negative", "mixed"), "mixed").alias("label")
    )


_SUBTYPES = ("thinking", "feeling", "sensing", "intuition", "judging", "perceiving", "extraversion", "introversion", "x")
_OPPOSITE = ("feeling", "thinking", "intuition", "sensing", "perceiving", "judging", "introversion", "extraversion", None)


@query("F24_opposite_subtype", f"""
SELECT event_id, {v.pick_sql('user_id % 9', v.quoted(_SUBTYPES))} AS subtype,
       {v.pick_sql('user_id % 9', v.quoted(_OPPOSITE))} AS opposite FROM events""")
def f24(spark, sf):
    subtype = v.pick(F.pmod("user_id", F.lit(9)), _SUBTYPES)
    df = v.table(spark, sf, "events").select("event_id", subtype.alias("subtype"))
    return df.withColumn("opposite", registry.opposite_subtype_column("subtype"))


@query("U3_cleaner_per_dataset", v.with_sql(v.FINANCE_SQL, select=f"""
SELECT model, row_id, {q.finance_form('prediction')} AS cleaned FROM finance"""))
def u3(spark, sf):
    forms = {d: tx.case_form("prediction", f) for d, f in registry.FINANCE_CASE.items()}
    return v.finance(spark, sf).select("model", "row_id", registry.by_dataset("dataset", forms).alias("cleaned"))


@query("U4_prompt_builder", f"""
SELECT doc_id, 'Summarize the following content in no more than 3 sentences.' || chr(10) || chr(10) ||
       {q.strip(_PADDED)} AS prompt FROM documents""")
def u4(spark, sf):
    df = _docs(spark, sf).select("doc_id", _padded().alias("query"))
    return df.select("doc_id", registry.prompt(registry.PROMPTS["edtsum"], tx.strip).alias("prompt"))


@query("U5_row_functions_as_columns", v.with_sql(v.HEALTH_SQL, select=f"""
SELECT model, row_id, {_TIDY} AS tidied, {q.resolve('prediction', q.normalize('gold'))} AS resolved,
       {q.letters('prediction')} AS letters FROM health"""))
def u5(spark, sf):
    df = v.health(spark, sf).withColumn("gold", tx.normalize_answer("gold"))
    return df.select(
        "model", "row_id", tx.normalize_prediction("prediction").alias("tidied"),
        tx.resolve_or_wrong("prediction", "gold").alias("resolved"), tx.letters_only("prediction").alias("letters"),
    )


@query("U6_aggregates_as_columns", v.with_sql(v.MARKET_SQL, f"""n AS (
  SELECT dataset, model, {q.match('prediction', ("bearish", "bullish", "neutral"))} AS label, count(*) AS n
  FROM market GROUP BY ALL), p AS (
  SELECT dataset, model, n / sum(n) OVER (PARTITION BY dataset, model) AS p FROM n)""", select="""
SELECT dataset, model, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY ALL"""))
def u6(spark, sf):
    counts = parsed_market(spark, sf).groupBy("dataset", F.col("model").alias("source"),
                                              F.col("prediction").alias("label")).agg(F.count("*").alias("n"))
    return rounded(dist.entropy(counts, v.MODEL_NAMES, unit="nats"), "entropy")
