"""Window matches against a plain scan of all windows."""

import hashlib
import random
import re

from gradewell.llm import decontamination as dec

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(docs, items):
    got = dec.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(map(tuple, got), key=repr) == want
    return want


def test_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = check(documents, items)
    kept = dec.drop_contaminated(documents, items)
    assert kept.columns == documents.columns and kept.count() == sum(not w[-1] for w in want)


def test_short_common_and_repeated_items(spark, edges, nothing):
    items = [(1, "the"), (2, "CAT sat"), (3, None), (None, "mat"), (4, "à"), (5, "À"), (6, " ".join(["the and"] * 12)), (7, "!"),
             (8, "another text"), (8, "same id"), (9, "word1 the and word2 the and word3 the and word4 the and word5"), (10, "nowhere to be found")]
    check(edges, spark.createDataFrame(items, "item_id long, text string"))
    assert dec.contamination(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {tuple(r)[2:4] for r in dec.contamination(edges, edges.selectExpr("doc_id AS item_id", "text").limit(0)).collect()} == {(0, 0)}


def test_without_broadcast(spark, documents, monkeypatch):
    from gradewell.llm import postings

    monkeypatch.setattr(postings, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        check(documents, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, item), (2, item.replace("eta theta", "eta so theta")), (3, "alpha " + "x " * 60 + "nu")]
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in
           dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1] == (1, 0) and got[2][0] == 0 and got[3] == (0, 0)


def near_counts(spark, docs, items):
    found = dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in found.collect()}


def test_every_single_edit_is_a_proximity_match(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    edits = [item[:i] + ["so"] + item[i:] for i in range(1, 13)] + [item[:i] + item[i + 1 :] for i in range(13)]
    edits += [item[:i] + ["so"] + item[i + 1 :] for i in range(13)] + [item[:6] + ["so"] * 5 + item[6:]]
    docs = [(i, "one two " + " ".join(x) + " three") for i, x in enumerate(edits)]
    docs += [(100, " ".join(item)), (101, " ".join(item + ["so"] * 30 + item)), (102, "alpha " + "x " * 60 + "nu"), (103, None), (104, "beta")]
    got = near_counts(spark, docs, [(1, " ".join(item))])
    lost = [i for i in range(len(edits)) if got[i] != (0, 1)]
    assert lost == []
    assert [got[i] for i in range(100, 105)] == [(1, 0), (1, 0), (0, 0), (0, 0), (0, 0)]


def test_proximity_of_repeated_and_unknown_words(spark):
    items = [(1, "red red blue"), (2, "green word that no document has anywhere stands here beside other things of yellow"), (3, "one")]
    docs = [(1, "red x"), (2, "red red blue"), (3, "red so red so blue"), (4, "green word so that there is beside the things yellow one")]
    assert near_counts(spark, docs, items) == {1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (1, 0)}


def near_by_definition(words, item, window=13, needed=10, slop=5):
    n = min(len(item), window)
    need = -(-n * needed // window)
    for start in range(len(item) - n + 1):
        for base in range(-len(item), len(words)):
            found = sum(any(0 <= i + d < len(words) and words[i + d] == item[i] for d in range(base, base + slop + 1)) for i in range(start, start + n))
            if found >= need:
                return True
    return False


def test_proximity_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 13, 16, 24])))) for k in range(12)]
    docs = []
    for i in range(120):
        text = rng.choices(vocabulary, k=rng.randint(0, 30))
        item = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 6)):  # edit at random, rare words too
            at = rng.randrange(len(item))
            kind = rng.randrange(3)
            item = item[:at] + ([] if kind == 0 else [rng.choice(vocabulary)] if kind == 1 else [rng.choice(vocabulary), item[at]]) + item[at + 1 :]
            item = item or ["w0"]
        at = rng.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + item + text[at:])))
    got = near_counts(spark, docs, items)
    exact = brute_force(docs, items)
    want = {}
    for i, text in docs:
        near = {k for k, t in items if near_by_definition(text.split(), t.split())}
        want[i] = (len(exact[i]), len(near - exact[i]))
    assert got == want and sum(n for _, n in want.values()) > 20


def brute_force(docs, items):
    found = {}
    for i, text in docs:
        own, spaced = set(), f" {text} "
        for k, t in items:
            w = t.split()
            n = min(len(w), 13)
            if any(f" {' '.join(w[s:s + n])} " in spaced for s in range(len(w) - n + 1)):
                own.add(k)
        found[i] = own
    return found


def test_registered_query_returns_proximity_matches(spark, tmp_path):
    from __spark_entry__ import queries

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, item), (2, item.replace("eta theta", "eta so theta")), (3, "no")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries()["op5_benchmark_decontamination"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in rows} == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_only_places_where_a_window_can_stand_are_written(spark, monkeypatch):
    """Every place of every anchor word was written with its context and read back twice; texts were split into words three times."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(i, f"{item.split()[i % 13]} and something else ") for i in range(500)]
    docs += [(500, item), (501, item.replace("eta theta", "eta so theta")), (502, None), (503, "")]
    written, write = {}, dec.hand_over

    def recorded(df, name, **how):
        out = write(df, name, **how)
        written[name] = out.count()
        return out

    monkeypatch.setattr(dec, "hand_over", recorded)
    assert near_counts(spark, docs, [(1, item)]) == {i: (0, 0) for i in range(504)} | {500: (1, 0), 501: (0, 1)}
    assert written.pop("words") == 504  # all texts, once
    assert max(written.values()) < 20


def test_short_items_of_which_one_word_is_no_near_anchor(spark):
    items = [(1, "red blue"), (2, "red blue green"), (3, "red blue green grey"), (4, "blue blue"), (5, "One"), (5, "blue Red")]
    docs = [(1, "RED blue"), (2, "blue red blue green"), (3, "red, blue. green! grey blue blue"), (4, "one blue"), (5, "red green"), (6, "blue red " * 40)]
    check(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_no_python_in_the_plan(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = dec.contamination(documents, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
