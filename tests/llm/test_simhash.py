"""Golay keys, links and components against brute force."""

import numpy as np
import xxhash

from gradewell.llm import simhash
from gradewell.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def brute_components(prints):
    """prints: {fingerprint: smallest id}; the smallest id of each fingerprint's component."""
    values = np.array(sorted(prints), np.uint64)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ value) <= 2):
            a, b = find(int(value)), find(int(values[i + 1 + j]))
            root[max(a, b)] = min(a, b)
    least = {}
    for p, doc in prints.items():
        r = find(p)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return {p: least[find(p)] for p in prints}


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    prints = {}
    for doc, text in rows:
        p = plain_fingerprint(text)
        known = prints.get(p)
        prints[p] = doc if known is None else known if doc is None else min(known, doc)
    whole = brute_components(prints)
    want = sorted(((d, f"{plain_fingerprint(t):016x}", whole[plain_fingerprint(t)]) for d, t in rows), key=repr)
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want
    return whole


def test_documents_equal_brute_force(documents, edges):
    check(documents)
    check(edges)


def test_one_row_of_each_component_stays(edges, nothing):
    kept = simhash.drop_near_duplicates(edges)
    values = np.array(sorted({plain_fingerprint(r["text"]) for r in edges.collect()}), np.uint64)
    groups = len(set(brute_components({int(v): int(v) for v in values}).values()))
    assert kept.columns == edges.columns and kept.count() == groups
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)[::37]
    index = simhash.nearest_index(words)
    codeword = (index << np.uint32(11)) | simhash.remainders(index << np.uint32(11))
    assert (simhash.remainders(codeword) == 0).all() and np.bitwise_count(codeword ^ words).max() <= 3
    rows, _ = simhash.near_indices(words, 23)
    assert set(np.bincount(rows).tolist()) == {1, 6}


def test_every_pair_within_two_bits_shares_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(6):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in base], np.uint64)
        (r1, k1), (r2, k2) = simhash.fuzzy_keys(base), simhash.fuzzy_keys(base ^ flips)
        one, two = [set() for _ in base], [set() for _ in base]
        for sets, rows, keys in ((one, r1, k1), (two, r2, k2)):
            for r, k in zip(rows.tolist(), keys.tolist()):
                sets[r].add(k)
        assert all(a & b for a, b in zip(one, two))


def test_large_runs_link_like_pairs():
    rng = np.random.default_rng(4)
    centre = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(centre ^ np.array([sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(700)], np.uint64))
    assert len(prints) > simhash.PAIRED_ROWS
    a, b = simhash.run_links(np.zeros(len(prints), np.int64), prints)
    assert (np.bitwise_count(a ^ b) <= 2).all()
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[find(x)] = find(y)
    whole = brute_components({int(p): int(p) for p in prints})
    assert len({find(int(p)) for p in prints}) == len(set(whole.values()))


def test_runs_across_batches():
    import pyarrow as pa

    keys = np.array([1, 2, 2, 2, 2, 2, 3, 3], np.int64)
    prints = np.array([0, 1, 3, 7, 15, 31, 8, 9], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(prints[i : i + 2])], names=["key", "fp"]) for i in range(0, 8, 2)]
    links = {(x["a"], x["b"]) for b in simhash._link_batches(batches) for x in b.to_pylist()}
    assert links == {(1, 3), (1, 7), (3, 7), (3, 15), (7, 15), (7, 31), (15, 31), (8, 9)}


def test_components_of_a_chain_and_a_hub(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1200).selectExpr("id AS a", "2000 AS b"))
    found = {r["vertex"]: r["root"] for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(1, 301)) and all(found[i] == 1000 for i in [*range(1001, 1200), 2000])
    assert components(links.limit(0)).count() == 0
