"""Scores of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import resample, summary, token_match
from gradewell.plans import jobs
from gradewell.queries import sqltext as q
from gradewell.queries import views as v
from gradewell.queries.registry import query
from gradewell.queries.scoring import rounded

_KEY = ("dataset", "model", "conv_id", "turn")
_KEYS = ", ".join(_KEY)


def _tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _grams(n: int) -> str:
    """(key, n, gram, r, p): how often each side has each gram."""
    gram = "ref[i]" if n == 1 else "ref[i] || ' ' || ref[i + 1]"
    out = []
    for side, counts in (("ref", "1 AS r, 0 AS p"), ("pred", "0 AS r, 1 AS p")):
        words = gram.replace("ref", side)
        out.append(f"SELECT {_KEYS}, {n} AS n, {words} AS gram, {counts} "
                   f"FROM words, LATERAL (SELECT unnest(range(1, len({side}) + {2 - n})) AS i)")
    return " UNION ALL ".join(out)


_ROUGE_N = f"""words AS (SELECT {_KEYS}, {_tokens('reference')} AS ref, {_tokens('prediction')} AS pred FROM summaries),
grams AS ({_grams(1)} UNION ALL {_grams(2)}),
counted AS (SELECT {_KEYS}, n, gram, sum(r) AS r, sum(p) AS p FROM grams GROUP BY ALL),
overlap AS (SELECT {_KEYS}, n, sum(least(r, p)) AS o, sum(r) AS r, sum(p) AS p FROM counted GROUP BY ALL),
scores AS (
  SELECT {_KEYS}, {', '.join(
      f"coalesce(max({expr}) FILTER (n = {n}), 0.0) AS {name}" for n in (1, 2) for expr, name in (
          (q.div('o', 'p'), f'rouge{n}_precision'), (q.div('o', 'r'), f'rouge{n}_recall'),
          (q.div('2 * o', 'r + p'), f'rouge{n}')))}
  FROM words LEFT JOIN overlap USING ({_KEYS}) GROUP BY ALL)"""
_N_COLUMNS = [f"rouge{n}{s}" for n in (1, 2) for s in ("_precision", "_recall", "")]


@query("T1_rouge_n", v.with_sql(v.SUMMARIES_SQL, _ROUGE_N, select=f"""
SELECT {_KEYS}, {', '.join(f'round({c}, 6) AS {c}' for c in _N_COLUMNS)} FROM scores"""))
def t1(spark, sf):
    return rounded(summary.rouge_n(v.summaries(spark, sf), _KEY, "reference", "prediction"), *_N_COLUMNS)


def _with_rouge(spark, sf, stemmed=False):
    return summary.with_rouge(v.summaries(spark, sf), "reference", "prediction", stemmed)


@query("T1_rouge_n_per_row", v.with_sql(v.SUMMARIES_SQL, _ROUGE_N, select=f"""
SELECT {_KEYS}, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM scores"""))
def t1_rows(spark, sf):
    return rounded(_with_rouge(spark, sf).select(*_KEY, "rouge1", "rouge2"), "rouge1", "rouge2")


# The longest common subsequence of all pairs at once, one reference word per step.
_LCS = f"""words AS (SELECT {_KEYS}, {_tokens('reference')} AS ref, {_tokens('prediction')} AS pred FROM summaries),
pairs AS (SELECT row_number() OVER () AS id, * FROM words),
cells AS (SELECT id, unnest(range(1, len(pred) + 1)) AS j, unnest(pred) AS w FROM pairs),
steps AS (
  SELECT id, 0 AS i, j, w, 0 AS n FROM cells
  UNION ALL
  SELECT id, i + 1, j, w,
         max(greatest(n, CASE WHEN w = ref[i + 1] THEN before + 1 ELSE 0 END)) OVER (PARTITION BY id ORDER BY j)
  FROM (SELECT s.id, s.i, s.j, s.w, s.n, p.ref, coalesce(lag(s.n) OVER (PARTITION BY s.id ORDER BY s.j), 0) AS before
        FROM steps s JOIN pairs p ON p.id = s.id AND s.i < len(p.ref))),
lcs AS (SELECT id, max(n) AS n FROM steps GROUP BY id)"""


@query("T2_rouge_l", v.with_sql(v.SUMMARIES_SQL, _LCS, select=f"""
SELECT {_KEYS}, round(coalesce(2.0::DOUBLE * n / nullif(len(ref) + len(pred), 0), 0), 6) AS "rougeL"
FROM pairs LEFT JOIN lcs USING (id)""").replace("WITH", "WITH RECURSIVE", 1))
def t2(spark, sf):
    return rounded(_with_rouge(spark, sf).select(*_KEY, "rougeL"), "rougeL")


# Scores over sentence unions and stems have no SQL form; they are tested against brute force on small texts.
@query("T3_rouge_lsum")
def t3(spark, sf):
    return rounded(_with_rouge(spark, sf).select(*_KEY, "rougeLsum"), "rougeLsum")


@query("T4_rouge_stemmed")
def t4(spark, sf):
    return rounded(_with_rouge(spark, sf, stemmed=True).select(*_KEY, *summary.ROUGE), *summary.ROUGE)


_DIMS, _PIECE = 64, 8


def token_vectors(spark, sf):
    """Each embedding cut into eight token vectors, beside those of the embedding before it."""
    pieces = F.array(*[F.slice("embedding", i + 1, _PIECE) for i in range(0, _DIMS, _PIECE)])
    vectors = v.table(spark, sf, "embeddings").select("vec_id", pieces.alias("vectors"))
    reference = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vectors").alias("ref_vectors"))
    return vectors.withColumnRenamed("vectors", "pred_vectors").join(reference, "vec_id")


_MATCH = f"""pieces AS (
  SELECT vec_id, i, embedding[(i * {_PIECE} + 1):((i + 1) * {_PIECE})]::DOUBLE[] AS t
  FROM embeddings, LATERAL (SELECT unnest(range(0, {_DIMS // _PIECE})) AS i)),
sims AS (
  SELECT p.vec_id, p.i AS pi, r.i AS ri, list_cosine_similarity(p.t, r.t) AS s
  FROM pieces p JOIN pieces r ON r.vec_id = p.vec_id - 1),
pr AS (SELECT vec_id, avg(s) AS p FROM (SELECT vec_id, pi, max(s) AS s FROM sims GROUP BY ALL) GROUP BY vec_id),
rc AS (SELECT vec_id, avg(s) AS r FROM (SELECT vec_id, ri, max(s) AS s FROM sims GROUP BY ALL) GROUP BY vec_id)"""


@query("T5_greedy_token_match", v.with_sql(_MATCH, select="""
SELECT vec_id, round(p, 6) AS match_precision, round(r, 6) AS match_recall, round(2 * p * r / (p + r), 6) AS match_f1
FROM pr JOIN rc USING (vec_id)"""))
def t5(spark, sf):
    out = summary.with_token_match(token_vectors(spark, sf), "ref_vectors", "pred_vectors")
    names = ("match_precision", "match_recall", "match_f1")
    return rounded(out.select("vec_id", *names), *names)


@query("A26_mean_scores", v.with_sql(v.SUMMARIES_SQL, _ROUGE_N, select=f"""
SELECT dataset, model, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _N_COLUMNS)}, count(*) AS pairs
FROM scores GROUP BY dataset, model"""))
def a26(spark, sf):
    scores = summary.rouge_n(v.summaries(spark, sf), _KEY, "reference", "prediction")
    return rounded(summary.mean_scores(scores, _N_COLUMNS), *_N_COLUMNS)


_WEIGHTS = f"""pair_numbers AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', {_KEYS})), 1, 8) AS BIGINT) % {resample.PRIME} AS number FROM scores),
factors AS (SELECT * FROM (VALUES {', '.join(f'({r}, {a}, {b})' for r, (a, b) in enumerate(resample.factors(resample.REPLICATES)))}) f(replicate, a, b)),
drawn AS (SELECT *, {' + '.join(f'CAST((a * number + b) % {resample.PRIME} >= {t} AS INT)' for t in resample.THRESHOLDS)} AS w FROM pair_numbers CROSS JOIN factors),
replicates AS (SELECT dataset, model, replicate, {', '.join(f'sum(w * {c}) / nullif(sum(w), 0) AS {c}' for c in ('rouge1', 'rouge2'))}
               FROM drawn GROUP BY dataset, model, replicate),
plain AS (SELECT dataset, model, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2, count(*) AS pairs FROM scores GROUP BY dataset, model)"""
_SIDES = [(c, side, point) for c in ("rouge1", "rouge2") for side, point in (("low", 0.025), ("mid", 0.5), ("high", 0.975))]


@query("A26_resampled_means", v.with_sql(v.SUMMARIES_SQL, _ROUGE_N, _WEIGHTS, select=f"""
SELECT p.dataset, p.model, round(any_value(p.rouge1), 6) AS rouge1, round(any_value(p.rouge2), 6) AS rouge2, any_value(pairs) AS pairs,
       {', '.join(f'round(quantile_cont(r.{c}, {point}), 6) AS {c}_{side}' for c, side, point in _SIDES)}
FROM replicates r JOIN plain p USING (dataset, model) GROUP BY p.dataset, p.model"""))
def a26_resampled(spark, sf):
    scores = summary.rouge_n(v.summaries(spark, sf), _KEY, "reference", "prediction")
    out = resample.resampled_means(scores, _KEY, ["rouge1", "rouge2"])
    return rounded(out, *[c for c in out.columns if c.startswith("rouge")])


# Token vectors from the embeddings table: a token takes the vector its MD5 points to, one in ten has none.
_TOKEN_NUMBER = "CAST('0x' || substr(md5(token), 1, 6) AS BIGINT)"
_TEXT_MATCH = f"""words AS (SELECT {_KEYS}, {_tokens('reference')} AS ref, {_tokens('prediction')} AS pred FROM summaries),
sides AS (SELECT {_KEYS}, FALSE AS side, unnest(ref) AS token FROM words UNION ALL SELECT {_KEYS}, TRUE, unnest(pred) FROM words),
counted AS (SELECT {_KEYS}, side, token, count(*) AS n FROM sides GROUP BY ALL),
weights AS (SELECT token, ln(((SELECT count(*) FROM words) + 1.0) / (count(*) FILTER (NOT side) + 1.0)) AS weight FROM counted GROUP BY token),
vocabulary AS (SELECT token, weight, CAST(embedding AS DOUBLE[]) AS vector FROM weights
               LEFT JOIN embeddings ON vec_id = {_TOKEN_NUMBER} % (SELECT count(*) FROM embeddings) AND {_TOKEN_NUMBER} % 10 > 0),
looked AS (SELECT {_KEYS}, side, token, n * weight AS weight, vector FROM counted JOIN vocabulary USING (token)),
sims AS (SELECT {', '.join(f'p.{k}' for k in _KEY)}, p.token AS pt, r.token AS rt, p.weight AS pw, r.weight AS rw,
                coalesce(list_cosine_similarity(p.vector, r.vector), 0) AS s
         FROM looked p JOIN looked r ON {' AND '.join(f'p.{k} = r.{k}' for k in _KEY)} WHERE p.side AND NOT r.side),
best_p AS (SELECT {_KEYS}, coalesce(sum(s * pw) / nullif(sum(pw), 0), 0) AS p FROM (SELECT {_KEYS}, pt, max(s) AS s, any_value(pw) AS pw FROM sims GROUP BY {_KEYS}, pt) GROUP BY {_KEYS}),
best_r AS (SELECT {_KEYS}, coalesce(sum(s * rw) / nullif(sum(rw), 0), 0) AS r FROM (SELECT {_KEYS}, rt, max(s) AS s, any_value(rw) AS rw FROM sims GROUP BY {_KEYS}, rt) GROUP BY {_KEYS}),
matches AS (SELECT {_KEYS}, coalesce(p, 0) AS match_precision, coalesce(r, 0) AS match_recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS match_f1
            FROM words LEFT JOIN best_p USING ({_KEYS}) LEFT JOIN best_r USING ({_KEYS}))"""


def _text_match(spark, sf):
    pairs = v.summaries(spark, sf)
    embeddings = v.table(spark, sf, "embeddings")
    words = pairs.select(F.explode(F.array_union(summary.tokens("reference"), summary.tokens("prediction"))).alias("token")).distinct()
    number = F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long")
    pointed = words.filter(number % 10 > 0).withColumn("vec_id", number % embeddings.count())
    vectors = pointed.join(embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("token", "vector")
    return token_match.match_texts(pairs, _KEY, "reference", "prediction", vectors)


@query("T5_token_match_of_texts", v.with_sql(v.SUMMARIES_SQL, _TEXT_MATCH, select=f"""
SELECT {_KEYS}, {', '.join(f'round({c}, 6) AS {c}' for c in token_match.NAMES)} FROM matches"""))
def t5_texts(spark, sf):
    return rounded(_text_match(spark, sf), *token_match.NAMES)


@query("C7_token_match_of_texts", v.with_sql(v.SUMMARIES_SQL, _TEXT_MATCH, select=f"""
SELECT dataset, model, {', '.join(f'round(avg({c}), 6) AS {c}' for c in token_match.NAMES)}, count(*) AS pairs FROM matches GROUP BY dataset, model"""))
def c7_texts(spark, sf):
    return rounded(summary.mean_scores(_text_match(spark, sf), token_match.NAMES), *token_match.NAMES)


# Pairs with the token vectors of the embedding of their conversation; C7 as a whole, but for the sentence union.
_MEANS = ("rouge1", "rouge2", "rougeL", "match_precision", "match_recall", "match_f1")


@query("C7_score_summaries_and_tokens", v.with_sql(v.SUMMARIES_SQL, _LCS, _ROUGE_N.split(",\n", 1)[1], _MATCH, select=f"""
SELECT p.dataset, p.model, {', '.join(f'round(avg({c}), 6) AS "{c}"' for c in _MEANS)}, count(*) AS pairs
FROM (SELECT s.dataset, s.model, s.rouge1, s.rouge2, 2.0::DOUBLE * coalesce(l.n, 0) / nullif(len(x.ref) + len(x.pred), 0) AS "rougeL",
             pr.p AS match_precision, rc.r AS match_recall, 2 * pr.p * rc.r / (pr.p + rc.r) AS match_f1
      FROM scores s JOIN pairs x USING ({_KEYS}) LEFT JOIN lcs l ON l.id = x.id
      JOIN pr ON pr.vec_id = s.conv_id + 1 JOIN rc ON rc.vec_id = s.conv_id + 1) p
GROUP BY p.dataset, p.model""").replace("WITH", "WITH RECURSIVE", 1))
def c7_tokens(spark, sf):
    vectors = token_vectors(spark, sf).withColumn("conv_id", F.col("vec_id") - 1)
    pairs = v.summaries(spark, sf).join(vectors, "conv_id")
    out = jobs.score_summaries(pairs, vectors=("ref_vectors", "pred_vectors"))
    return rounded(out.select("dataset", "model", *_MEANS, "pairs"), *_MEANS)


@query("C7_score_summaries")
def c7(spark, sf):
    return rounded(jobs.score_summaries(v.summaries(spark, sf)), *summary.ROUGE)


@query("C7_score_summaries_stemmed")
def c7_stemmed(spark, sf):
    return rounded(jobs.score_summaries(v.summaries(spark, sf), stemmed=True), *summary.ROUGE)
