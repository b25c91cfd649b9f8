"""Registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewell.llm import (
    class_lm, conversation_sql, decontamination, exact_dedup, fertility, html_text, language_id, license_scan, packing, prefix_trie, quality,
    sharding, simhash, structure_repair,
)
from gradewell.llm.common import on_table, read_table


def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_license_scan": on_table(license_scan.scan),
    "op2_sampled_splitter_shards": on_table(sharding.assign_shards),
    "op3_best_fit_packing": on_table(packing.pack_documents),
    "op4_language_id": on_table(language_id.identify),
    "op5_benchmark_decontamination": _contamination,
    "op6_html_text": on_table(html_text.extract, "pages"),
    "op7_simhash_near_dedup": on_table(simhash.near_duplicates),
    "op8_quality_classifier": _quality,
    "op9_class_lm": on_table(class_lm.score_texts),
    "op10_exact_dedup": on_table(exact_dedup.duplicate_groups),
    "op11_tokenizer_fertility": on_table(fertility.judge),
    "op12_structure_repair": on_table(structure_repair.repair_damaged, "conversations"),
    "op13_prefix_trie": on_table(prefix_trie.rebuilt_trie, "conversations"),
}

# Words of a text with A-Z lower-cased.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _rows(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_PHRASE_ROWS = [("base", p) for p in license_scan.PHRASES] + sorted({("key", k) for _, keys in license_scan.TEMPLATES.values() for k in keys})
_LABEL_OF = "CASE phrase " + " ".join(f"WHEN '{p}' THEN '{name}'" for p, name in license_scan.PHRASES.items()) + " END"
_LICENSE_SQL = f"""
        WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
        phrases AS (SELECT kind, phrase, string_split(phrase, ' ') AS p FROM ({_rows(_PHRASE_ROWS)}) t(kind, phrase)),
        notices AS (SELECT label, string_split(notice, ' ') AS p FROM ({_rows([(k, n) for k, (n, _) in license_scan.TEMPLATES.items()])}) t(label, notice)),
        needed AS (SELECT * FROM ({_rows([(k, x) for k, (_, keys) in license_scan.TEMPLATES.items() for x in keys])}) t(label, phrase)),
        tokens AS (SELECT row, unnest(range(1, len(w) + 1)) AS s, lower(unnest(w)) AS term FROM docs),
        vocabulary AS (SELECT DISTINCT unnest(p) AS term FROM (SELECT p FROM phrases UNION ALL SELECT p FROM notices)),
        seen AS (SELECT term, count(DISTINCT row) AS df FROM tokens JOIN vocabulary USING (term) GROUP BY term),
        idf AS (SELECT term, coalesce(df, 0) AS df, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + coalesce(df, 0))) + 1 AS weight
                FROM vocabulary LEFT JOIN seen USING (term)),
        spelled AS (SELECT label, unnest(range(1, len(p) + 1)) AS place, unnest(p) AS term FROM notices),
        rare AS (SELECT label, term FROM (SELECT DISTINCT label, term, df FROM spelled JOIN idf USING (term))
                 QUALIFY row_number() OVER (PARTITION BY label ORDER BY df, term) <= {license_scan.TEMPLATE_WORDS}),
        postings AS (SELECT label, place, term, weight, sum(weight) OVER (PARTITION BY label) AS total
                     FROM spelled JOIN rare USING (label, term) JOIN idf USING (term)),
        shares AS (SELECT row, label, max(share) AS share FROM (
                     SELECT row, label, s - place AS shift, sum(weight) / min(total) AS share FROM tokens JOIN postings USING (term)
                     GROUP BY ALL) GROUP BY ALL HAVING max(share) >= {license_scan.LEAST_SHARE} - 1e-9),
        exact AS (SELECT row, s, kind, phrase FROM tokens JOIN phrases ON p[1] = term JOIN docs USING (row) WHERE w[s:s + len(p) - 1] = p),
        base AS (SELECT row, count(*) AS n_base, min(s) - 1 AS first_word, max(s) - 1 AS last_word,
                        list_sort(list(DISTINCT {_LABEL_OF})) AS labels FROM exact WHERE kind = 'base' GROUP BY row),
        complete AS (SELECT row, label, min(share) AS share FROM shares JOIN needed USING (label)
                     LEFT JOIN (SELECT DISTINCT row, phrase, 1 AS here FROM exact WHERE kind = 'key') USING (row, phrase)
                     GROUP BY ALL HAVING count(here) = count(*)),
        own AS (SELECT row, list(label) AS labels, max(least(share, 1.0)) AS best FROM complete GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(base.labels, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
               round(CAST(coalesce(best, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE), 6) AS score
        FROM docs LEFT JOIN base USING (row) LEFT JOIN own USING (row)
    """

_W, _REACH = decontamination.WINDOW_WORDS, decontamination.WINDOW_WORDS - 1 + decontamination.SLOP

ORACLES = {
    "op1_license_scan": _LICENSE_SQL,
    "op5_benchmark_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item, least(len(w), {decontamination.WINDOW_WORDS}) AS n,
                 array_to_string(w[s:s + least(len(w), {decontamination.WINDOW_WORDS}) - 1], ' ') AS phrase
          FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - {decontamination.WINDOW_WORDS}, 0) + 2)) AS s)
          WHERE len(w) > 0),
        places AS (
          SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
          FROM (SELECT row, w, n FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows)),
               LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
        hits AS (SELECT DISTINCT row, s, n, item FROM places JOIN windows USING (n, phrase)),
        covered AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row),
        found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row),
        -- proximity: the rarest words of each window, then the words around every place of them
        tokens AS (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
        counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
        spelled AS (SELECT row_number() OVER () AS spelling, item, w FROM (SELECT DISTINCT item, w FROM items WHERE len(w) > 0)),
        starts AS (SELECT spelling, item, w, least(len(w), {_W}) AS n,
                          CAST(ceil(least(len(w), {_W}) * {decontamination.NEAR_WORDS}.0 / {_W}) AS INT) AS need,
                          unnest(range(1, greatest(len(w) - {_W}, 0) + 2)) AS s FROM spelled),
        offsets AS (SELECT *, unnest(range(s, s + n)) AS i FROM starts),
        anchors AS (SELECT spelling, item, w AS iw, offsets.n, need, i, w[i] AS word, len(list_distinct(w[s:s + offsets.n - 1])) - offsets.n + need AS least
                    FROM offsets LEFT JOIN counts ON counts.word = w[i]
                    QUALIFY row_number() OVER (PARTITION BY spelling, s ORDER BY coalesce(counts.n, 0), i) <= offsets.n - need + 1),
        chosen AS (SELECT spelling, item, iw, n, need, i, word, min(least) AS least FROM anchors GROUP BY ALL),
        around AS (SELECT row, item, n, need, least, iw[greatest(i - n + 1, 1):i + n - 1] AS iw, least(i, n) AS ia,
                          w[greatest(p - {_REACH}, 1):p + {_REACH}] AS dw, least(p, {_REACH} + 1) AS da
                   FROM tokens JOIN chosen USING (word) JOIN docs USING (row)),
        likely AS (SELECT * FROM around WHERE len(list_intersect(dw, iw)) >= least AND len(iw) >= n),
        placed AS (SELECT *, list_transform(range(1, len(iw) + 1), lambda j: list_filter(range(-{decontamination.SLOP}, {decontamination.SLOP} + 1),
                          lambda d: da + j - ia + d >= 1 AND dw[da + j - ia + d] = iw[j])) AS m FROM likely),
        near AS (SELECT row, count(DISTINCT item) AS n_near_items FROM placed
                 WHERE len(list_filter(range(1, len(iw) - n + 2), lambda s: len(list_filter(range(-{decontamination.SLOP}, 1), lambda low:
                       len(list_filter(m[s:s + n - 1], lambda ds: len(list_filter(ds, lambda d: d BETWEEN low AND low + {decontamination.SLOP})) > 0)) >= need)) > 0)) > 0
                   AND (row, item) NOT IN (SELECT row, item FROM hits) GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit > 0 AND {decontamination.HIT_SHARE} * n_hit >= len(w), FALSE) AS contaminated,
               coalesce(n_near_items, 0) AS n_near_items
        FROM docs LEFT JOIN covered USING (row) LEFT JOIN found USING (row) LEFT JOIN near USING (row)
    """,
    "op10_exact_dedup": r"""
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM (
            SELECT doc_id, sha256(body) AS text_sha256,
                min(doc_id) OVER (PARTITION BY body) AS keep_id,
                count(*) OVER (PARTITION BY body) AS group_size,
                row_number() OVER (PARTITION BY body ORDER BY doc_id) AS n
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents))
    """,
    "op12_structure_repair": conversation_sql.REPAIR,
    "op13_prefix_trie": conversation_sql.TRIE,
}
