"""Exact duplicates against grouping in Python."""

import hashlib
import random
import re
from collections import defaultdict

from gradewell.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for body, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep, sha = (known[0] if known else None), hashlib.sha256(body.encode()).hexdigest()
        stayed = False
        for i in ids:
            kept = i == keep and not stayed
            stayed |= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(documents, edges):
    for df in (documents, edges):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = exact_dedup.duplicate_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_rows_that_stay_keep_all_columns(edges, nothing):
    kept = exact_dedup.drop_duplicates(edges)
    assert kept.columns == edges.columns
    rows = [tuple(r) for r in edges.select("doc_id", "text").collect()]
    want = sorted((i for i, _, _, k, _ in brute(rows) if k), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want
    assert exact_dedup.duplicate_groups(nothing).count() == 0 and exact_dedup.drop_duplicates(nothing).count() == 0


def test_small_chunks_make_many_local_owners(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMBINE_BYTES", 400)
    df = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text").coalesce(1)
    got = exact_dedup.duplicate_groups(df).select("doc_id", "keep_id", "group_size").collect()
    assert all(r["keep_id"] == r["doc_id"] % 7 for r in got) and {r["group_size"] for r in got} <= {42, 43}


def test_trie_equals_dictionary_with_and_without_spill():
    rng = random.Random(5)
    words = [b"", b"a", b"ab", b"abc", b"b"] + [bytes(rng.choices(b"ab", k=rng.randrange(1, 40))) for _ in range(3000)]
    for limit in (None, 30_000, 2_000):
        trie, want = exact_dedup.PatriciaTrie(limit), defaultdict(list)
        for i, key in enumerate(rng.choices(words, k=9000)):
            trie.insert(key, (i, 0))
            want[key].append((i, 0))
        got = sorted(sorted(g) for g in trie.groups())
        assert got == sorted(want.values())
        assert bool(trie.spilled) == (limit is not None)


def test_normalised_text():
    for text in ("", " ", "a", " a", "a\t\n b ", "\x0b\x0c", "é  ü", "a\x1cb"):
        assert exact_dedup.normalised(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)
