"""Shaping of downloaded tables into datasets."""

from __future__ import annotations

from gradewell.operators import corpus
from gradewell.queries import views as v
from gradewell.queries.registry import query


@query("C16_prepare_corpus", """
SELECT text, CASE status WHEN 'en' THEN '1' WHEN 'fr' THEN '0' END AS label FROM (
  SELECT text, lang AS status FROM documents WHERE n_chars < 1000 UNION ALL
  SELECT text, lang FROM documents WHERE n_chars >= 1000) WHERE status IN ('en', 'fr', 'de')""")
def c16(spark, sf):
    docs = v.table(spark, sf, "documents")
    train, validation = docs.filter("n_chars < 1000"), docs.filter("n_chars >= 1000")
    return corpus.prepare_corpus(
        [train, validation], {"text": "text", "lang": "label"}, keep={"lang": ("en", "fr", "de")},
        labels={"en": "1", "fr": "0"},
    )


@query("C16_prepare_corpus_first_rows", """
SELECT o_orderkey AS id, o_orderpriority AS text, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' END AS label
FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 5000""")
def c16_first(spark, sf):
    return corpus.prepare_corpus(
        [v.table(spark, sf, "orders")], {"o_orderkey": "id", "o_orderpriority": "text", "o_orderstatus": "label"},
        keep={"o_orderstatus": ("F", "O")}, labels={"F": "1", "O": "0"}, order=["o_orderkey"], limit=5000,
    )
