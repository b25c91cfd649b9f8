"""Label counts and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.functions import text as tx
from gradewell.operators import distribution as dist
from gradewell.operators import metrics, repair
from gradewell.plans import jobs
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.projections import _SETS
from gradewell.queries.registry import query
from gradewell.queries.scoring import rounded
from gradewell.registry import LabelTask

# Answered documents with gold codes mapped and both sides cleaned; all languages share two labels.
_CLEAN = f"""cleaned AS (
  SELECT dataset, model, row_id, text, prediction AS raw,
         CASE gold WHEN '0' THEN 'negative' WHEN '1' THEN 'positive' END AS gold,
         {q.letters('prediction')} AS pred FROM answered)"""
_ALLOWED = "('negative', 'positive')"
_TRUE_COUNTS = f"""true_counts AS (
  SELECT dataset, gold AS label, 'true' AS source, count(*) AS n FROM cleaned
  WHERE model = 'base' AND gold IN {_ALLOWED} GROUP BY dataset, gold)"""
_EXACT = f"""counts AS (
  SELECT * FROM true_counts UNION ALL
  SELECT dataset, pred, model, count(*) FROM cleaned WHERE pred IN {_ALLOWED} GROUP BY dataset, pred, model)"""
_OPEN = """counts AS (
  SELECT * FROM true_counts UNION ALL
  SELECT dataset, pred, model, count(*) FROM cleaned WHERE pred IS NOT NULL GROUP BY dataset, pred, model)"""
_CONTAINED = f"""labels_of AS (SELECT unnest(['negative', 'positive']) AS label),
groups AS (SELECT DISTINCT dataset, model FROM cleaned),
contained AS (
  SELECT g.dataset, l.label, g.model AS source, count(c.row_id) AS n
  FROM groups g CROSS JOIN labels_of l
  LEFT JOIN cleaned c ON c.dataset = g.dataset AND c.model = g.model AND contains(c.pred, l.label)
  GROUP BY ALL),
counts AS (
  SELECT g.dataset, l.label, 'true' AS source, coalesce(max(t.n), 0) AS n
  FROM groups g CROSS JOIN labels_of l LEFT JOIN true_counts t ON t.dataset = g.dataset AND t.label = l.label
  GROUP BY ALL
  UNION ALL SELECT * FROM contained)"""
_WIDE = """wide AS (
  SELECT dataset, label, CAST(coalesce(sum(n) FILTER (source = 'true'), 0) AS BIGINT) AS "true",
         CAST(coalesce(sum(n) FILTER (source = 'base'), 0) AS BIGINT) AS base,
         CAST(coalesce(sum(n) FILTER (source = 'f'), 0) AS BIGINT) AS f,
         CAST(coalesce(sum(n) FILTER (source = 't'), 0) AS BIGINT) AS t
  FROM counts GROUP BY dataset, label)"""
_LONG = """long AS (
  SELECT dataset, label, 'base' AS model, base AS n FROM wide UNION ALL SELECT dataset, label, 'f', f FROM wide
  UNION ALL SELECT dataset, label, 't', t FROM wide),
shares AS (
  SELECT dataset, label, model, CASE WHEN n = 0 THEN 1e-12 ELSE CAST(n AS DOUBLE) / sum(n) OVER w END AS p
  FROM long WINDOW w AS (PARTITION BY dataset, model))"""


def _cleaned(spark, sf):
    return jobs.cleaned_labels(v.answered_documents(spark, sf), v.REVIEW_TASKS)


def _open(spark, sf):
    return dist.open_counts(_cleaned(spark, sf), _SETS, v.MODEL_NAMES, pred="cleaned_prediction")


@query("A11_exact_allowed_counts", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _EXACT, select="SELECT * FROM counts"))
def a11(spark, sf):
    return dist.exact_counts(_cleaned(spark, sf), _SETS, v.MODEL_NAMES, pred="cleaned_prediction")


@query("A12_containment_counts", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _CONTAINED,
                                            select="SELECT * FROM counts"))
def a12(spark, sf):
    return dist.containment_counts(_cleaned(spark, sf), _SETS, v.MODEL_NAMES, pred="cleaned_prediction")


@query("A12_containment_open_label_set", """
WITH words AS (SELECT DISTINCT d.lang AS dataset, lower(substr(b.text, 1, 4 + CAST(b.item_id % 5 AS INTEGER))) AS label
  FROM benchmark b CROSS JOIN (SELECT DISTINCT lang FROM documents) d)
SELECT t.lang AS dataset, w.label, count(*) AS n FROM documents t
JOIN words w ON w.dataset = t.lang AND contains(lower(t.text), w.label) GROUP BY ALL""")
def a12_open(spark, sf):
    """Beginnings of the benchmark items as labels of every language, looked for in the whole texts."""
    docs = v.table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.lower("text").alias("prediction"))
    begin = F.lower(F.expr("substring(text, 1, 4 + cast(item_id % 5 as int))"))
    words = v.table(spark, sf, "benchmark").select(begin.alias("label"))
    labels = words.select(F.explode(F.array(*[F.lit(x) for x in v.LANGS])).alias("dataset"), "label").distinct()
    return dist.containment_pairs(docs, labels, by=["dataset"])


# Customers answer with the name of a part brand or its neighbour; the label set is every gold name of a dataset.
_NAMED_SQL = """named AS (
  SELECT CAST(p_size % 3 AS VARCHAR) AS dataset, m.model, p_partkey AS row_id,
         regexp_replace(lower(p_name), '[^a-z]+', '', 'g') AS gold,
         CASE (p_partkey * m.k + m.c) % 4 WHEN 0 THEN regexp_replace(lower(p_name), '[^a-z]+', '', 'g') WHEN 1 THEN 'none'
           WHEN 2 THEN 'x' || regexp_replace(lower(p_name), '[^a-z]+', '', 'g') || 'y' END AS pred
  FROM part CROSS JOIN """ + v.MODELS_SQL + """),
sets AS (SELECT DISTINCT dataset, gold AS label FROM named),
counts AS (
  SELECT dataset, gold AS label, 'true' AS source, count(*) AS n FROM named WHERE model = 'base' GROUP BY ALL UNION ALL
  SELECT n.dataset, s.label, n.model, count(*) FROM named n
  JOIN sets s ON s.dataset = n.dataset AND contains(n.pred, s.label) GROUP BY ALL)"""


@query("A22_large_label_set", v.with_sql(_NAMED_SQL, select="""
SELECT dataset, label, CAST(coalesce(sum(n) FILTER (source = 'true'), 0) AS BIGINT) AS "true",
       CAST(coalesce(sum(n) FILTER (source = 'base'), 0) AS BIGINT) AS base,
       CAST(coalesce(sum(n) FILTER (source = 'f'), 0) AS BIGINT) AS f,
       CAST(coalesce(sum(n) FILTER (source = 't'), 0) AS BIGINT) AS t
FROM counts GROUP BY dataset, label"""))
def a22_large(spark, sf):
    """C8 over datasets without a configured label set: hundreds of gold names each."""
    parts = v.per_model(v.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    rows = parts.selectExpr(
        "'names' as task", "cast(p_size % 3 as string) as dataset", "model", "p_partkey as row_id", "p_name as text",
        "p_name as gold",
        v.pick_expr("(p_partkey * k + c) % 4", ("p_name", "'none'", "concat('x', p_name, 'y')", None)) + " as prediction",
    )
    tasks = [LabelTask(str(i), f"{i}.csv", f"results/{i}") for i in range(3)]
    return jobs.label_audit(rows, tasks, v.MODEL_NAMES).table


@query("A13_open_counts", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, select="SELECT * FROM counts"))
def a13(spark, sf):
    return _open(spark, sf)


_PAIRS = """pairs AS (
  SELECT dataset, model, gold, pred FROM cleaned c
  WHERE pred IN (SELECT gold FROM cleaned g WHERE g.dataset = c.dataset AND g.model = c.model)),
sides AS (SELECT dataset, model, gold AS label, 1 AS t, 0 AS p FROM pairs
  UNION ALL SELECT dataset, model, pred, 0, 1 FROM pairs),
ratios AS (
  SELECT dataset, model, label, CAST(sum(p) AS DOUBLE) / sum(sum(p)) OVER w AS pred_ratio,
         CAST(sum(t) AS DOUBLE) / sum(sum(t)) OVER w AS true_ratio
  FROM sides GROUP BY dataset, model, label WINDOW w AS (PARTITION BY dataset, model)),
bias AS (SELECT *, pred_ratio - true_ratio AS bias FROM ratios)"""


def _pairs(spark, sf):
    return dist.valid_confusion(_cleaned(spark, sf), pred="cleaned_prediction")


@query("A14_distribution_bias", v.with_sql(v.ANSWERED_SQL, _CLEAN, _PAIRS, select="""
SELECT dataset, model, label, round(pred_ratio, 6) AS pred_ratio, round(true_ratio, 6) AS true_ratio,
       round(bias, 6) AS bias FROM bias"""))
def a14(spark, sf):
    return rounded(dist.distribution_bias(_pairs(spark, sf)), "pred_ratio", "true_ratio", "bias")


_ALLOWED_BIAS = """totals AS (
  SELECT dataset, sum("true") AS tt, sum(base) AS tb, sum(f) AS tf, sum(t) AS tx FROM wide GROUP BY dataset),
allowed_bias AS (
  SELECT w.dataset, w.label, round(base / greatest(1, tb) - "true" / tt, 6) AS base,
         round(f / greatest(1, tf) - "true" / tt, 6) AS f, round(t / greatest(1, tx) - "true" / tt, 6) AS t
  FROM wide w JOIN totals o ON o.dataset = w.dataset)"""


@query("A15_allowed_bias", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _EXACT, _WIDE, _ALLOWED_BIAS,
                                      select="SELECT * FROM allowed_bias"))
def a15(spark, sf):
    counts = dist.exact_counts(_cleaned(spark, sf), _SETS, v.MODEL_NAMES, pred="cleaned_prediction")
    return rounded(dist.allowed_bias(counts, v.MODEL_NAMES), *v.MODEL_NAMES)


@query("A16_relative_shift", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _WIDE, select="""
SELECT dataset, label, model, CASE WHEN base = 0 THEN NULL ELSE round((n - base) * 100.0::DOUBLE / base, 6) END AS shift
FROM (SELECT dataset, label, base, 'f' AS model, f AS n FROM wide
      UNION ALL SELECT dataset, label, base, 't', t FROM wide)"""))
def a16(spark, sf):
    return rounded(dist.relative_shift(_open(spark, sf), v.MODEL_NAMES), "shift")


@query("A17_entropy", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _WIDE, _LONG, select="""
SELECT dataset, model, round(-sum(p * log2(p)), 6) AS entropy FROM shares GROUP BY ALL"""))
def a17(spark, sf):
    return rounded(dist.entropy(_open(spark, sf), v.MODEL_NAMES), "entropy")


_KL = """kl AS (SELECT q.dataset, q.model, sum(q.p * log2(q.p / b.p)) AS kl
  FROM shares q JOIN shares b ON b.dataset = q.dataset AND b.label = q.label AND b.model = 'base'
  WHERE q.model <> 'base' GROUP BY ALL)"""


@query("A18_kl_divergence", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _WIDE, _LONG, _KL,
                                       select="SELECT dataset, model, round(kl, 6) AS kl FROM kl"))
def a18(spark, sf):
    return rounded(dist.kl_divergence(_open(spark, sf), v.MODEL_NAMES), "kl")


_COLLAPSED = f"""collapsed AS (
  SELECT dataset, source, CASE WHEN label IN {_ALLOWED} THEN label ELSE 'invalid' END AS label,
         CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL)"""


@query("A19_collapse_invalid", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _COLLAPSED,
                                          select="SELECT * FROM collapsed"))
def a19(spark, sf):
    return dist.collapse_invalid(_open(spark, sf), _SETS)


_SHARES = v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _COLLAPSED, select="""
SELECT dataset, source, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset, source), 6) AS share
FROM collapsed""")


@query("A20_share_of_total", _SHARES)
def a20(spark, sf):
    return rounded(dist.share_of_total(dist.collapse_invalid(_open(spark, sf), _SETS)), "share")


@query("W6_share_within_group", v.with_sql(v.MARKET_SQL, select="""
SELECT dataset, model, gold, count(*) AS n,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY dataset, model), 6) AS share
FROM market GROUP BY dataset, model, gold"""))
def w6(spark, sf):
    counts = v.market(spark, sf).groupBy("dataset", "model", "gold").agg(F.count("*").alias("n"))
    return rounded(dist.share_of_total(counts, ["dataset", "model"]), "share")


@query("A21_distinct_values", v.with_sql(v.HEALTH_SQL, select=f"""
SELECT DISTINCT dataset, model, 'label' AS side, {q.normalize('gold')} AS value FROM health
UNION SELECT DISTINCT dataset, model, 'prediction', {q.normalize('prediction')} FROM health WHERE prediction IS NOT NULL"""))
def a21(spark, sf):
    df = v.health(spark, sf)
    return dist.distinct_values(
        df.withColumns({c: tx.normalize_answer(c) for c in ("gold", "prediction")}), "gold", "prediction"
    )


@query("A22_gold_label_sets", v.with_sql(v.FINANCE_SQL, select="""
SELECT DISTINCT dataset, lower(gold) AS label FROM finance"""))
def a22(spark, sf):
    return dist.gold_label_sets(v.finance(spark, sf).withColumn("gold", F.lower("gold")))


@query("R1_wide_label_table", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _WIDE, select="SELECT * FROM wide"))
def r1(spark, sf):
    return dist.wide_counts(_open(spark, sf), [dist.TRUE, *v.MODEL_NAMES])


_REPORT = f"{_PAIRS},\n{q.macro('pairs')}"


def _wide_metric_columns() -> str:
    out = []
    for label in ("negative", "positive"):
        for source, name in (("pred_ratio", f"Pred_{label}_ratio"), ("true_ratio", f"True_{label}_ratio"),
                             ("bias", f"Bias_{label}"), ("precision", f"{label}_precision"), ("recall", f"{label}_recall"),
                             ("f1", f"{label}_f1-score")):
            out.append(f"round(max({source}) FILTER (b.label = '{label}'), 6) AS \"{name}\"")
        out.append(f"max(support) FILTER (b.label = '{label}') AS \"{label}_support\"")
    return ", ".join(out)


_WIDE_METRICS = f"""wide_metrics AS (
  SELECT b.dataset, b.model, {_wide_metric_columns()} FROM bias b
  LEFT JOIN label_scores s ON s.dataset = b.dataset AND s.model = b.model AND s.label = b.label
  GROUP BY b.dataset, b.model)"""


def _wide_metrics(spark, sf):
    pairs = _pairs(spark, sf)
    report = metrics.label_report(pairs, pred="pred", weight="n")
    wide = dist.wide_metrics(dist.distribution_bias(pairs), report, ("negative", "positive"))
    doubles = [c for c in wide.columns if c not in ("dataset", "model") and not c.endswith("support")]
    return wide.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in doubles})


@query("R2_wide_metrics", v.with_sql(v.ANSWERED_SQL, _CLEAN, _REPORT, _WIDE_METRICS, select="SELECT * FROM wide_metrics"))
def r2(spark, sf):
    return _wide_metrics(spark, sf)


@query("R3_transpose_models", v.with_sql(v.ANSWERED_SQL, _CLEAN, _REPORT, _WIDE_METRICS, """doubles AS (
  SELECT dataset, model, CAST(COLUMNS(* EXCLUDE (dataset, model)) AS DOUBLE) FROM wide_metrics),
long AS (UNPIVOT doubles ON COLUMNS(* EXCLUDE (dataset, model)) INTO NAME metric VALUE value)""", select="""
SELECT dataset, metric, max(value) FILTER (model = 'base') AS base, max(value) FILTER (model = 'f') AS f,
       max(value) FILTER (model = 't') AS t FROM long GROUP BY dataset, metric"""))
def r3(spark, sf):
    return dist.transpose_models(_wide_metrics(spark, sf), v.MODEL_NAMES)


@query("R4_bias_matrix", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _EXACT, _WIDE, _ALLOWED_BIAS, select="""
SELECT b.dataset, b.label, b.base AS bias_base, b.f AS bias_f, b.t AS bias_t, w."true", w.base, w.f, w.t
FROM allowed_bias b JOIN wide w ON w.dataset = b.dataset AND w.label = b.label"""))
def r4(spark, sf):
    counts = dist.exact_counts(_cleaned(spark, sf), _SETS, v.MODEL_NAMES, pred="cleaned_prediction")
    bias = rounded(dist.allowed_bias(counts, v.MODEL_NAMES), *v.MODEL_NAMES)
    bias = bias.withColumnsRenamed({m: f"bias_{m}" for m in v.MODEL_NAMES})
    return dist.wide_counts(counts, [dist.TRUE, *v.MODEL_NAMES]).join(bias, ["dataset", "label"])


@query("C8_label_audit", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _CONTAINED, _WIDE, select="SELECT * FROM wide"))
def c8(spark, sf):
    return jobs.label_audit(v.answered_documents(spark, sf), v.REVIEW_TASKS, v.MODEL_NAMES).table


def _labeller():
    """Stands for a remote labeller: long answers are negative, errors fail."""

    def label(answer: str) -> str:
        if answer.startswith("[Error]"):
            raise RuntimeError("cannot label an error")
        return " Negative" if len(answer) > 3 else "no label"

    return label


RELABEL = {lang: (("mixed", "neutral"), ("positive", "negative", "mixed"), "mixed") for lang in v.LANGS}
_LABEL_SQL = """CASE WHEN pred IN ('mixed', 'neutral') THEN pred
  WHEN raw IS NULL THEN 'mixed' WHEN raw LIKE '[Error]%' THEN 'mixed'
  WHEN length(raw) > 3 THEN 'negative' ELSE 'mixed' END"""
_INVALID = f"""invalid AS (
  SELECT *, {_LABEL_SQL} AS sentiment_label FROM cleaned
  WHERE NOT coalesce(contains(pred, 'positive') OR contains(pred, 'negative'), FALSE))"""
_PROCESSED = f"""last_fix AS (
  SELECT dataset, model, text, arg_max(sentiment_label, row_id) AS sentiment_label FROM invalid GROUP BY ALL),
merged AS (
  SELECT c.dataset, c.model, c.row_id, c.gold, coalesce(f.sentiment_label, c.raw) AS raw
  FROM cleaned c LEFT JOIN last_fix f ON f.dataset = c.dataset AND f.model = c.model AND f.text = c.text),
processed AS (SELECT dataset, model, row_id, gold, {q.letters('raw')} AS pred FROM merged),
true_counts AS (SELECT dataset, gold AS label, 'true' AS source, count(*) AS n FROM processed
  WHERE model = 'base' AND gold IS NOT NULL GROUP BY dataset, gold),
counts AS (SELECT * FROM true_counts UNION ALL
  SELECT dataset, pred, model, count(*) FROM processed WHERE pred IS NOT NULL GROUP BY dataset, pred, model)"""


@query("U2_fallback_labeller", v.with_sql(v.ANSWERED_SQL, _CLEAN, _INVALID, select="""
SELECT dataset, model, row_id, sentiment_label FROM invalid"""))
def u2(spark, sf):
    invalid = jobs.label_audit(v.answered_documents(spark, sf), v.REVIEW_TASKS, v.MODEL_NAMES).invalid
    out = repair.label_unresolved(invalid, {lang: _labeller for lang in v.LANGS}, RELABEL)
    return out.select("dataset", "model", "row_id", "sentiment_label")


def processed(spark, sf):
    return jobs.repair_labels(
        v.answered_documents(spark, sf), {lang: _labeller for lang in v.LANGS}, v.REVIEW_TASKS, v.MODEL_NAMES, RELABEL, ()
    )


@query("C9_repair_labels", v.with_sql(v.ANSWERED_SQL, _CLEAN, _INVALID, _PROCESSED, _WIDE, select="SELECT * FROM wide"))
def c9(spark, sf):
    return jobs.open_label_table(processed(spark, sf), v.REVIEW_TASKS, v.MODEL_NAMES)


@query("C10_bias_report", v.with_sql(v.ANSWERED_SQL, _CLEAN, _REPORT, select="""
SELECT b.dataset, b.model, b.label, round(pred_ratio, 6) AS pred_ratio, round(true_ratio, 6) AS true_ratio,
       round(bias, 6) AS bias, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM bias b LEFT JOIN label_scores s ON s.dataset = b.dataset AND s.model = b.model AND s.label = b.label"""))
def c10(spark, sf):
    out = jobs.bias_report(v.answered_documents(spark, sf), v.REVIEW_TASKS)
    return rounded(out, "pred_ratio", "true_ratio", "bias", "precision", "recall", "f1")


@query("C10_bias_table", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _EXACT, _WIDE, _ALLOWED_BIAS,
                                    select="SELECT * FROM allowed_bias"))
def c10_table(spark, sf):
    out = jobs.bias_table(v.answered_documents(spark, sf), v.REVIEW_TASKS, v.MODEL_NAMES)
    return rounded(out, *v.MODEL_NAMES)


@query("C11_distribution_report", v.with_sql(v.ANSWERED_SQL, _CLEAN, _TRUE_COUNTS, _OPEN, _WIDE, _LONG, _KL, """h AS (
  SELECT dataset, model, -sum(p * log2(p)) AS entropy FROM shares GROUP BY ALL)""", select="""
SELECT h.dataset, h.model, round(entropy, 6) AS entropy, round(kl, 6) AS kl
FROM h LEFT JOIN kl ON kl.dataset = h.dataset AND kl.model = h.model"""))
def c11(spark, sf):
    return rounded(jobs.distribution_report(_open(spark, sf), v.MODEL_NAMES), "entropy", "kl")
