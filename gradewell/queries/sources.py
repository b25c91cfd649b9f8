"""Tables go through files of each format in the shared folder, whole, and come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions import text as tx
from gradewell.operators import distribution as dist
from gradewell.operators import scoring
from gradewell.operators.preferences import flat_pairs
from gradewell.plans import jobs
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.distributions import _CLEAN
from gradewell.queries.projections import RECORDS_SQL, records
from gradewell.queries.registry import query
from gradewell.queries.scoring import _PARSED_MARKET, _PARSED_REVIEWS, _binary, parsed_market
from gradewell.registry import LabelTask, prompt
from gradewell.schema import FLAT_PREFERENCE, INSTRUCTION
from gradewell.session import scratch_path
from gradewell.sources import lines, sinks, tables

_DOC_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
                                      ("source", T.StringType()), ("n_chars", T.LongType()))]
)


@query("S1_csv_scan", "SELECT * FROM documents")
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    sinks.write_csv(v.table(spark, sf, "documents"), path)
    return tables.read_csv(spark, path, _DOC_SCHEMA)


@query("S2_csv_scan_trimmed_header", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""")
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    padded = v.table(spark, sf, "conversations").withColumnsRenamed({"role": " role ", "text": "text  "})
    sinks.write_csv(padded, path, bom=True)
    return tables.read_csv_trimmed(spark, path)


def _write_lines(df, path, header):
    """One text column as lines under a header line, as a damaged file would have them."""
    out = df.select(F.col("line").alias(header))
    out.write.option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)


_BARE = """bare AS (
  SELECT event_id, CAST(event_id AS VARCHAR) || CASE WHEN user_id % 10 = 9 THEN '' ELSE ',' || event_type END ||
         CASE user_id % 10 WHEN 9 THEN '' WHEN 8 THEN ',extra,' ELSE ',' || user_id END AS line
  FROM events)"""


@query("S3_bare_csv_with_rejects", v.with_sql(_BARE, select="""
SELECT split_part(line, ',', 1) AS event_id, split_part(line, ',', 2) AS event_type, split_part(line, ',', 3) AS user_id,
       CAST(NULL AS VARCHAR) AS rejected FROM bare WHERE len(string_split(line, ',')) = 3
UNION ALL SELECT NULL, NULL, NULL, line FROM bare WHERE len(string_split(line, ',')) NOT IN (1, 3)"""))
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    kind = F.pmod("user_id", F.lit(10))
    parts = [
        F.col("event_id").cast("string"),
        F.when(kind == 9, "").otherwise(F.concat(F.lit(","), "event_type")),
        F.when(kind == 9, "").when(kind == 8, ",extra,").otherwise(F.concat(F.lit(","), F.col("user_id").cast("string"))),
    ]
    _write_lines(v.table(spark, sf, "events").select(F.concat(*parts).alias("line")), path, "event_id,event_type,user_id")
    body = lines.body_lines(spark, path)
    rows, rejects = lines.split_bare_csv(body, "event_id,event_type,user_id")
    return rows.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        rejects.select(F.col("value").alias("rejected")), allowMissingColumns=True
    )


@query("S4_json_array_scan", v.with_sql(v.DIALOGUE_SQL, select="""
SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) % 50 AS position, question AS instruction, reply AS output
FROM dialogue"""))
def s4(spark, sf):
    path = scratch_path(spark, "s4")
    rows = v.dialogue(spark, sf).withColumnsRenamed({"question": "instruction", "reply": "output"})
    sinks.write_json_arrays(rows, path, ["instruction", "output"], ["conv_id", "turn"], rows_per_file=50)
    return tables.read_json_array(spark, f"{path}/*.txt", INSTRUCTION).drop("file_name")


@query("S5_instruction_files", v.with_sql(RECORDS_SQL, select="""
SELECT 'decision' AS dimension, subtype, position, instruction, output FROM records"""))
def s5_files(spark, sf):
    """Instruction tables of JSON lines, read back through the glob with the keys of their names."""
    folder = scratch_path(spark, "s5")
    rows = records(spark, sf)
    for subtype in ("feeling", "thinking"):
        own = rows.filter(F.col("subtype") == subtype).select("position", "instruction", "output")
        sinks.write_json(own, f"{folder}/en_decision_{subtype}.json")
    return tables.read_instruction_lines(spark, folder)


@query("S5_keys_from_file_name", """
SELECT doc_id, lang AS dimension, source AS subtype FROM documents WHERE lang <> 'es'""")
def s5(spark, sf):
    docs = v.table(spark, sf, "documents")
    # Spanish files lack the language part of their name.
    name = F.when(F.col("lang") == "es", F.concat("lang", F.lit("_"), "source", F.lit(".json"))).otherwise(
        F.concat(F.lit("en_"), "lang", F.lit("_"), "source", F.lit(".json"))
    )
    return tables.keys_from_name(docs.select("doc_id", name.alias("file_name"))).drop("file_name")


@query("S6_training_rows", v.with_sql(RECORDS_SQL, select="""
SELECT a.instruction AS prompt, a.output AS chosen, b.output AS rejected
FROM records a JOIN records b ON a.position = b.position WHERE a.subtype = 'thinking' AND b.subtype = 'feeling'"""))
def s6(spark, sf):
    path = scratch_path(spark, "s6")
    sinks.write_csv(flat_pairs(records(spark, sf), "decision", "thinking").drop("position"), path)
    return tables.read_training_rows(spark, path, FLAT_PREFERENCE)


@query("S6_training_first_rows", v.with_sql(RECORDS_SQL, select="""
SELECT a.position, a.instruction AS prompt, a.output AS chosen, b.output AS rejected
FROM records a JOIN records b ON a.position = b.position WHERE a.subtype = 'thinking' AND b.subtype = 'feeling'
ORDER BY a.position LIMIT 200"""))
def s6_first(spark, sf):
    path = scratch_path(spark, "s6")
    sinks.write_json(flat_pairs(records(spark, sf), "decision", "thinking"), path)
    schema = T.StructType([T.StructField("position", T.LongType()), *FLAT_PREFERENCE.fields])
    return tables.read_training_rows(spark, path, schema, fmt="json", order=["position"], limit=200)


# Whole turns on one line, then two words; system turns end otherwise.
_TAIL = "CASE WHEN role = 'system' THEN '!' ELSE ' positive  ' || role END"
_FLAT = f"flat AS (SELECT conv_id, turn, role, replace(text, chr(10), ' ') || {_TAIL} AS line FROM conversations)"


@query("S7_last_two_words", v.with_sql(_FLAT, select=f"""
SELECT {q.strip("regexp_extract(line, '^(.*?)(\\s+)(\\w+)\\s+(\\w+)$', 1)")} AS text, 'positive' AS answer, role AS prediction
FROM flat WHERE role <> 'system'"""))
def s7(spark, sf):
    path = scratch_path(spark, "s7")
    tail = F.when(F.col("role") == "system", "!").otherwise(F.concat(F.lit(" positive  "), "role"))
    line = F.concat(F.translate("text", "\n", " "), tail)
    _write_lines(v.table(spark, sf, "conversations").select(line.alias("line")), path, "text answer prediction")
    return lines.split_last_words(lines.body_lines(spark, path))


_INDEXED = """indexed AS (
  SELECT conv_id * 100 + turn AS idx, trim(replace(text, chr(10), ' ')) AS text, turn % 2 AS label,
         CASE turn % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'neutral' ELSE 'unsure' END AS prediction FROM conversations)"""


@query("S8_indexed_lines", v.with_sql(_INDEXED, select="""
SELECT CAST(idx AS VARCHAR) AS idx, text, CAST(label AS VARCHAR) AS label, lower(prediction) AS prediction,
       CAST(NULL AS VARCHAR) AS rejected FROM indexed WHERE prediction <> 'unsure'
UNION ALL SELECT NULL, NULL, NULL, NULL, idx || ',' || text || ',"' || label || '", ' || prediction FROM indexed
WHERE prediction = 'unsure'"""))
def s8(spark, sf):
    path = scratch_path(spark, "s8")
    text = F.trim(F.translate("text", "\n", " "))
    said = v.pick(F.pmod("turn", F.lit(3)), ("Positive", "neutral", "unsure"))
    line = F.concat(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string"), F.lit(","), text, F.lit(',"'),
        F.pmod("turn", F.lit(2)).cast("string"), F.lit('", '), said,
    )
    _write_lines(v.table(spark, sf, "conversations").select(line.alias("line")), path, "idx text label prediction")
    rows, rejects = lines.split_indexed(lines.body_lines(spark, path))
    return rows.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        rejects.select(F.col("value").alias("rejected")), allowMissingColumns=True
    )


_TREE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("row_id", "text", "gold")])


def _tree(spark, sf):
    """Reviews as one result folder per dataset and model, read back dataset by dataset."""
    root = scratch_path(spark, "tree")
    out = v.reviews(spark, sf).select("row_id", "text", "gold", "prediction", "dataset", "model")
    sinks.write_csv(out, root, partition_by=("dataset", "model"))
    tasks = [LabelTask(lang, "*.csv", f"dataset={lang}", v.POLARITY, label_col="gold") for lang in (*v.LANGS, "it")]
    folders = {m: f"model={m}" for m in v.MODEL_NAMES}
    parts = [tables.read_results(spark, root, t, folders, _TREE_SCHEMA) for t in tasks]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found, tasks


@query("S9_result_tree_scan", v.with_sql(v.REVIEWS_SQL, select="""
SELECT dataset, model, text, gold, nullif(prediction, 'n/a') AS prediction FROM reviews"""))
def s9(spark, sf):
    return _tree(spark, sf)[0].drop("row_id")


_MIXED_ROWS = """
SELECT dataset, model, text, gold, nullif(prediction, 'n/a') AS prediction FROM reviews WHERE dataset = 'de' UNION ALL
SELECT dataset, model, NULL, gold, nullif(replace(prediction, ',', ''), 'n/a') FROM reviews
WHERE dataset = 'en' AND prediction IS NOT NULL"""


def _mixed_tree(spark, sf):
    """A tree with good files (de), files of whole lines in quotes (en), files without a prediction column (es),
    files of a header only (fr), and none at all (it)."""
    root = scratch_path(spark, "mixed")
    rows = v.reviews(spark, sf).select("row_id", "text", "gold", "prediction", "dataset", "model")
    for model in v.MODEL_NAMES:
        own = rows.filter(F.col("model") == model)
        german = own.filter("dataset = 'de'").select("row_id", "text", "gold", "prediction")
        sinks.write_csv(german, f"{root}/dataset=de/model={model}")
        plain = F.concat_ws(",", F.col("row_id").cast("string"), "gold", F.replace("prediction", F.lit(","), F.lit("")))
        english = own.filter("dataset = 'en' and prediction is not null")
        line = F.concat(F.lit('"'), plain, F.lit('"')).alias("line")
        _write_lines(english.select(line), f"{root}/dataset=en/model={model}", '"row_id,gold,prediction"')
        sinks.write_csv(own.filter("dataset = 'es'").select("row_id", "text", "gold"), f"{root}/dataset=es/model={model}")
        sinks.write_csv(german.limit(0), f"{root}/dataset=fr/model={model}")
    tasks = [LabelTask(lang, "*.csv", f"dataset={lang}", v.POLARITY, label_col="gold") for lang in (*v.LANGS, "it")]
    return tables.read_result_tree(spark, root, tasks, {m: f"model={m}" for m in v.MODEL_NAMES})


@query("S9_mixed_result_tree", v.with_sql(v.REVIEWS_SQL, select=_MIXED_ROWS))
def s9_mixed(spark, sf):
    return _mixed_tree(spark, sf).rows.drop("row_id")


@query("S9_missing_files", v.with_sql(v.REVIEWS_SQL, select="""
SELECT l.dataset, m.model, 'missing' AS what FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) l(dataset)
CROSS JOIN (SELECT DISTINCT model FROM reviews) m
WHERE l.dataset NOT IN ('es', 'fr') AND l.dataset NOT IN (SELECT dataset FROM reviews)
UNION ALL SELECT DISTINCT dataset, model, 'skipped' FROM reviews WHERE dataset = 'es'"""))
def s9_missing_files(spark, sf):
    tree = _mixed_tree(spark, sf)
    skipped = {tuple(part.split("=")[1] for part in file.split("/")[-3:-1]) for file, _ in tree.skipped}
    found = [(*pair, "missing") for pair in tree.missing] + [(*pair, "skipped") for pair in skipped]
    return spark.createDataFrame(found, "dataset string, model string, what string")


@query("S9_missing_results", """
SELECT l.dataset, m.model FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) l(dataset)
CROSS JOIN (VALUES ('base'), ('f'), ('t')) m(model)
WHERE l.dataset NOT IN (SELECT d.lang FROM labels b JOIN documents d ON d.doc_id = b.doc_id)""")
def s9_missing(spark, sf):
    found, tasks = _tree(spark, sf)
    return tables.missing_results(found, tasks, v.MODEL_NAMES)


@query("S10_csv_sink", v.with_sql(v.FINANCE_SQL, select="SELECT dataset, model, row_id, gold, prediction FROM finance"))
def s10(spark, sf):
    path = scratch_path(spark, "s10")
    out = v.finance(spark, sf).select("dataset", "model", "row_id", "gold", "prediction")
    sinks.write_csv(out, path, bom=True)
    return spark.read.schema(out.schema).option("header", True).option("escape", '"').csv(path)


@query("S10_parquet_sink", v.with_sql(v.HEALTH_SQL, select="SELECT * FROM health"))
def s10_parquet(spark, sf):
    path = scratch_path(spark, "s10")
    sinks.write_predictions(v.health(spark, sf), path)
    return spark.read.parquet(path)


@query("S11_json_sink", v.with_sql(v.DIALOGUE_SQL, select="SELECT * FROM dialogue"))
def s11(spark, sf):
    path = scratch_path(spark, "s11")
    out = v.dialogue(spark, sf)
    sinks.write_json(out, path)
    return spark.read.schema(out.schema).json(path)


_BLOCK = " || chr(10) || ".join(
    f"'{c}: ' || coalesce(CAST({x} AS VARCHAR), 'nan')" for c, x in (
        ("dataset", "dataset"), ("model", "model"), ("accuracy", "round(accuracy, 4)"),
        ("precision", "round(precision, 4)"), ("recall", "round(recall, 4)"), ("f1", "round(f1, 4)"), ("count", "count"))
)


@query("S12_metric_report", v.with_sql(v.REVIEWS_SQL, _PARSED_REVIEWS, select=f"""
SELECT {_BLOCK} || chr(10) || repeat('-', 40) AS value FROM ({_binary('1', 'parsed')})"""))
def s12(spark, sf):
    path = scratch_path(spark, "s12")
    metrics = jobs.score_polarity(v.reviews(spark, sf))
    columns = {"accuracy": 4, "precision": 4, "recall": 4, "f1": 4, "count": None}
    sinks.write_report(metrics, path, ["dataset", "model"], columns)
    block = spark.read.option("lineSep", "-" * 40 + "\n").text(path).filter("value <> ''")
    return block.select(F.concat("value", F.lit("-" * 40)).alias("value"))


@query("S13_report_by_dataset", v.with_sql(v.MARKET_SQL, _PARSED_MARKET, select="""
SELECT dataset, pred AS label, count(*) FILTER (model = 'base') AS base, count(*) FILTER (model = 'f') AS f,
       count(*) FILTER (model = 't') AS t FROM parsed GROUP BY ALL"""))
def s13(spark, sf):
    path = scratch_path(spark, "s13")
    counts = parsed_market(spark, sf).groupBy(
        "dataset", F.col("model").alias("source"), F.col("prediction").alias("label")
    ).agg(F.count("*").alias("n"))
    sinks.write_by_dataset(dist.wide_counts(counts, v.MODEL_NAMES), path)
    schema = "label string, base long, f long, t long, dataset string"
    return spark.read.schema(schema).option("header", True).csv(path)


_S14_SQL = v.with_sql(v.HEALTH_SQL, select=f"""
SELECT model, row_id, CASE WHEN regexp_matches(lower({q.strip('prediction')}), '^[a-z]+$') THEN lower({q.strip('prediction')})
       WHEN contains(lower(prediction), 'depression') THEN 'depression'
       WHEN contains(lower(prediction), 'normal') THEN 'normal' ELSE prediction END AS prediction FROM health""")


@query("S14_rewrite_result", _S14_SQL)
def s14(spark, sf):
    first, second = scratch_path(spark, "s14"), scratch_path(spark, "s14")
    v.health(spark, sf).select("model", "row_id", "prediction").write.parquet(first)
    return sinks.rewrite_table(
        spark, first, second, lambda df: df.withColumn("prediction", tx.normalize_prediction("prediction"))
    )


@query("S14_change_in_place", _S14_SQL)
def s14_in_place(spark, sf):
    root = scratch_path(spark, "s14-versions")
    sinks.write_version(v.health(spark, sf).select("model", "row_id", "prediction"), root, 0)
    return sinks.change_table(spark, root, lambda df: df.withColumn("prediction", tx.normalize_prediction("prediction")))


@query("S15_invalid_side_output", v.with_sql(v.ANSWERED_SQL, _CLEAN, select="""
SELECT dataset, model, row_id, raw AS prediction, pred AS cleaned_prediction FROM cleaned
WHERE NOT coalesce(contains(pred, 'positive') OR contains(pred, 'negative'), FALSE)"""))
def s15(spark, sf):
    path = scratch_path(spark, "s15")
    invalid = jobs.label_audit(v.answered_documents(spark, sf), v.REVIEW_TASKS, v.MODEL_NAMES).invalid
    out = invalid.select("row_id", "prediction", "cleaned_prediction", "dataset", "model")
    sinks.write_invalid(out, path)
    return spark.read.schema(out.schema).option("header", True).option("escape", '"').csv(path)


def _factory(model: str):
    """Stands for a loaded text model: answers by prompt length, fails on some."""

    def answer(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("prompt rejected")
        return f"{model}: {'positive' if len(prompt) % 2 else 'negative'}"

    return answer


_ANSWERED_PROMPTS = (v.DIALOGUE_SQL, f"""prompts AS (
  SELECT conv_id, turn, m.model, 'Review:' || chr(10) || question || chr(10) || chr(10) || 'Sentiment:' AS prompt
  FROM dialogue CROSS JOIN {v.MODELS_SQL})""")
_ANSWERS = """
SELECT conv_id, turn, model, prompt, CASE WHEN length(prompt) % 7 = 0 THEN '[Error] prompt rejected'
  WHEN length(prompt) % 2 = 1 THEN model || ': positive' ELSE model || ': negative' END AS prediction FROM prompts"""


def _prompts(spark, sf):
    rows = v.dialogue(spark, sf).select("conv_id", "turn", prompt("Review:\n{question}\n\nSentiment:").alias("prompt"))
    return scoring.for_models(rows, v.MODEL_NAMES)


@query("U1_batch_scoring", v.with_sql(*_ANSWERED_PROMPTS, select=_ANSWERS))
def u1(spark, sf):
    return scoring.append_answers(_prompts(spark, sf), _factory, spread=("conv_id", "turn"))


@query("U1_answer_log", v.with_sql(*_ANSWERED_PROMPTS, select=_ANSWERS))
def u1_log(spark, sf):
    """One model's answers first, then all models' from the same log, which asks only the other two."""
    log = scratch_path(spark, "answers")
    rows = _prompts(spark, sf)
    scoring.answers_from_log(rows.filter(F.col("model") == v.MODEL_NAMES[0]), _factory, log)
    return scoring.answers_from_log(rows, _factory, log)
