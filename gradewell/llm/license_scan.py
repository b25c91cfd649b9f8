"""Licence phrases and notices in texts, by a positional index of rare licence words; DataFrame functions only.

The words of all phrases and notice templates get an inverse document frequency from the whole corpus. Every phrase is
looked up by its rarest word, every template by its few rarest words. The index holds the places of these words with
the words around them. A phrase place counts if the words around agree with the whole phrase. For a template, the
highest-IDF licence words of each file meet the template's postings; the shift at which most IDF weight agrees decides
its share, and a template is reported if at least half its weight agrees at one shift and all its mandatory key phrases
stand in the file.

Null text has no words. Rows that repeat id and text get equal results. The score is the best share of a reported
template, to six places; a phrase without any template scores one half, nothing scores zero.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.common import WORD, hand_over
from gradewell.llm.postings import agreement, postings, raw_words, small, whole

# Phrases and labels that the contract fixes.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# label: (notice text, mandatory key phrases). Notices are the customary public ones, shortened.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2",)),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met", ("redistribution and use in source and binary forms",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", ("cc by nd",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-attribution": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",)),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted", ("for any purpose with or without fee",)),
    "lgpl-2.1": ("gnu lesser general public license version 2 1", ("gnu lesser general public license",)),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files", ("permission is hereby granted free of charge",)),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",)),
}

# Rarest words by which a template is found, and rarest licence words of a file that are looked up (more than all
# templates have together now, so that a file may hold every licence).
TEMPLATE_WORDS, FILE_WORDS = 4, 128
LEAST_SHARE = 0.5
_AROUND = 15


def _inverse_frequencies(docs: DataFrame, text_col: str) -> dict[str, float]:
    """IDF over the whole table of every word in phrases and templates; their number is fixed."""
    vocabulary = sorted({w for t in [*PHRASES, *(n for n, _ in TEMPLATES.values()), *(k for _, ks in TEMPLATES.values() for k in ks)]
                         for w in t.split()})
    found = F.regexp_extract_all(F.lower(whole(F.col(text_col))), F.lit(WORD), F.lit(0))
    known = F.array_intersect(found, F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(F.array_append(known, F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}


def _quoted(words: list[str]) -> str:
    assert all(re.fullmatch(r"[a-z0-9]+", w) for w in words)
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "CAST(array() AS array<string>)"


def _lookup(spark: SparkSession, idf: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Phrase anchors (term, kind, phrase, at, length, before, after) and template postings (term, label, at, weight, total)."""
    phrases, weights = [], []
    wanted = [("base", p) for p in PHRASES] + sorted({("key", k) for _, keys in TEMPLATES.values() for k in keys})
    for kind, phrase in wanted:
        words = phrase.split()
        at = max(range(len(words)), key=lambda i: (idf[words[i]], -i))
        phrases.append(f"('{words[at]}', '{kind}', '{phrase}', {at}L, {len(words)}L, {_quoted(words[:at][::-1])}, {_quoted(words[at:])})")
    for label, (notice, _) in TEMPLATES.items():
        words = notice.split()
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:TEMPLATE_WORDS]
        places = [(i, w) for i, w in enumerate(words) if w in rare]
        total = sum(idf[w] for _, w in places)
        weights += [f"('{w}', '{label}', {i}L, {idf[w]!r}D, {total!r}D)" for i, w in places]
    return (
        spark.sql(f"SELECT * FROM VALUES {', '.join(phrases)} AS t(term, kind, phrase, at, length, p_before, p_after)"),
        spark.sql(f"SELECT * FROM VALUES {', '.join(weights)} AS t(term, label, at, weight, total)"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    phrases, templates = _lookup(spark, _inverse_frequencies(docs, text_col))
    terms = phrases.select("term").union(templates.select("term"))
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))]
    index = hand_over(  # rows that repeat id and text are one file
        postings(docs, keys, F.col(text_col), terms, _AROUND).dropDuplicates(["k0", "k1", "pos"]), "licence-postings"
    )

    met = index.join(F.broadcast(phrases), "term")  # a fixed few dozen rows
    back, ahead = agreement(F.col("before"), F.col("p_before")), agreement(F.col("after"), F.col("p_after"))
    exact = met.where((back >= F.col("at")) & (ahead >= F.col("length") - F.col("at"))).withColumn(
        "start", F.col("pos") - F.col("at")
    )
    label_of = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    base = F.col("kind") == "base"
    found = exact.groupBy("k0", "k1").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, label_of[F.col("phrase")]))).alias("base"),
        F.collect_set(F.when(~base, F.col("phrase"))).alias("key_phrases"),
    )

    # The highest-IDF licence words of each file, then their template postings by relative position.
    ranked = index.join(F.broadcast(templates), "term")
    words_of_file = ranked.groupBy("k0", "k1").agg(
        F.slice(F.sort_array(F.collect_set(F.struct("weight", "term")), asc=False), 1, FILE_WORDS)["term"].alias("rare")
    )
    same = F.col("k0").eqNullSafe(F.col("f0")) & (F.col("k1") == F.col("f1"))
    looked_up = ranked.join(words_of_file.withColumnsRenamed({"k0": "f0", "k1": "f1"}), same).where(
        F.array_contains(F.col("rare"), F.col("term"))
    )
    aligned = looked_up.groupBy("k0", "k1", "label", (F.col("pos") - F.col("at")).alias("shift")).agg(
        (F.sum("weight") / F.first("total")).alias("share")
    )
    best = aligned.groupBy("k0", "k1", "label").agg(F.max("share").alias("share")).where(F.col("share") >= LEAST_SHARE - 1e-9)
    keys_of = F.create_map(*[x for label, (_, ks) in TEMPLATES.items() for x in (F.lit(label), F.array(*[F.lit(k) for k in ks]))])
    verified = best.join(
        found.select(F.col("k0").alias("f0"), F.col("k1").alias("f1"), "key_phrases"), same
    ).where(F.size(F.array_except(keys_of[F.col("label")], F.col("key_phrases"))) == 0)
    more = verified.groupBy("k0", "k1").agg(
        F.collect_set("label").alias("own"), F.max(F.least("share", F.lit(1.0))).alias("best")
    ).withColumnsRenamed({"k0": "f0", "k1": "f1"})

    none = F.array().cast("array<string>")
    per_text = found.join(more, same, "left").select(
        "k0", "k1", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("own", none)))).alias("labels"),
        F.round(F.coalesce("best", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )
    per_text, _ = small(per_text, "licences")
    every = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
        F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"),
    )
    joined = every.join(per_text, every["doc_id"].eqNullSafe(per_text["k0"]) & (every["h"] == per_text["k1"]), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
