"""Summary scores against quadratic brute force."""

import math
import random
import re
from collections import Counter

import pytest

from gradewell.functions.stem import stem
from gradewell.operators import summary
from gradewell.plans import jobs


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def walk(t, a, b):
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_lcs(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
    b = [rng.choice("abcde") for _ in range(rng.randrange(0, 150))]
    t = lcs_table(a, b)
    assert summary.lcs_length(a, b) == t[-1][-1]
    assert summary._lcs_places(a, b) == walk(t, a, b)


def sum_score(ref, pred):
    refs, preds = ([re.findall("[a-z0-9]+", s.lower()) for s in x.split("\n") if s] for x in (ref, pred))
    left_r, left_p = Counter(w for s in refs for w in s), Counter(w for s in preds for w in s)
    hits = 0
    for r in refs:
        union = set()
        for p in preds:
            union |= walk(lcs_table(r, p), r, p)
        for i in sorted(union):
            if left_r[r[i]] > 0 and left_p[r[i]] > 0:
                hits += 1
                left_r[r[i]] -= 1
                left_p[r[i]] -= 1
    n, m = sum(map(len, refs)), sum(map(len, preds))
    return 2 * hits / (n + m) if hits else 0.0


TEXTS = ["The cat sat on the mat.", "a cat, the cat\nsat: on THE hat", "", "...", "dogs", "one\n\ntwo one\nthree", None,
         "the the the the", "three two one the"]


def pairs(spark):
    rows = [(i * 10 + j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "id long, ref string, pred string")


@pytest.mark.parametrize("null_as_text", [True, False])
def test_row_scores(spark, null_as_text):
    rows, df = pairs(spark)
    got = {r["id"]: r for r in summary.with_rouge(df, "ref", "pred", null_as_text=null_as_text).collect()}
    grams = {r["id"]: r for r in summary.rouge_n(df, ["id"], "ref", "pred", null_as_text=null_as_text).collect()}
    for key, a, b in rows:
        a, b = (("nan" if null_as_text else "") if x is None else x for x in (a, b))
        assert grams[key]["rouge1"] == pytest.approx(got[key]["rouge1"])
        wa, wb = (re.findall("[a-z0-9]+", x.lower()) for x in (a, b))
        for n, name in ((1, "rouge1"), (2, "rouge2")):
            ga, gb = (Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for w in (wa, wb))
            both = sum((ga & gb).values())
            want = 2 * both / (sum(ga.values()) + sum(gb.values())) if both else 0.0
            assert got[key][name] == pytest.approx(want)
        length = lcs_table(wa, wb)[-1][-1]
        assert got[key]["rougeL"] == pytest.approx(2 * length / (len(wa) + len(wb)) if length else 0.0)
        assert got[key]["rougeLsum"] == pytest.approx(sum_score(a, b))


def test_pairs_with_one_key_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "a")], "id long, ref string, pred string")
    with pytest.raises(Exception, match="two pairs share the key"):
        summary.rouge_n(df, ["id"], "ref", "pred").collect()


def test_aggregate_form_agrees_with_row_form(spark):
    _, df = pairs(spark)
    df = df.fillna("nan", ["ref", "pred"])
    rows = {r["id"]: r for r in summary.with_rouge(df, "ref", "pred").collect()}
    grams = summary.rouge_n(df, ["id"], "ref", "pred").collect()
    assert len(grams) == len(rows)
    for r in grams:
        assert r["rouge1"] == pytest.approx(rows[r["id"]]["rouge1"])
        assert r["rouge2"] == pytest.approx(rows[r["id"]]["rouge2"])


def test_aggregate_form_shuffles_once(spark):
    _, df = pairs(spark)
    plan = summary.rouge_n(df, ["id"], "ref", "pred")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_grams_are_counted_in_the_row_of_their_pair(spark):
    """Grams as rows filled the aggregate's memory and spilled many times the text."""
    _, df = pairs(spark)
    plan = summary.rouge_n(df, ["id"], "ref", "pred")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    # The shuffle carries keys and counts, not texts.
    exchange = plan[plan.index("Exchange hashpartitioning"):].split("\n")[1]
    assert "HashAggregate" in exchange and "_ref" not in exchange and "_pred" not in exchange


def test_clipped_counts_of_repeated_grams(spark):
    words = ["b", "a", "a", "", "é", "aa"]
    rng = random.Random(3)
    rows = [(i, *(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(2))) for i in range(60)]
    got = {r["id"]: r for r in summary.rouge_n(spark.createDataFrame(rows, "id long, ref string, pred string"), ["id"], "ref", "pred", (1, 2, 3)).collect()}
    for key, *texts in rows:
        sides = [re.findall("[a-z0-9]+", t) for t in texts]
        for n in (1, 2, 3):
            r, p = (Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for w in sides)
            both = (r & p).total()
            want = (both / p.total() if p else 0, both / r.total() if r else 0, 2 * both / (r.total() + p.total()) if r or p else 0)
            assert tuple(got[key][f"rouge{n}{x}"] for x in ("_precision", "_recall", "")) == pytest.approx(want)


def test_long_pair():
    rng = random.Random(1)
    a, b = (" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(4000)) for _ in range(2))
    scores = summary.pair_scores(a, b)
    assert scores[2] == scores[3] > 0.5


def test_stem():
    # Published examples of the algorithm's steps.
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
        "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal",
        "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
        "adjustable": "adjust", "defensible": "defens", "replacement": "replac", "adoption": "adopt",
        "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "news": "news", "is": "is",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stemmed_scores(spark):
    df = spark.createDataFrame([("running dogs jumped", "run dog jumps")], "ref string, pred string")
    # Words of three letters or fewer are not stemmed.
    assert summary.with_rouge(df, "ref", "pred", stemmed=True).first()["rouge1"] == 1.0
    assert summary.with_rouge(df, "ref", "pred").first()["rouge1"] == 0.0


def test_token_match(spark):
    rng = random.Random(2)

    def vectors(n):
        return [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(n)]

    rows = [(i, vectors(rng.randrange(1, 9)), vectors(rng.randrange(1, 9))) for i in range(20)]
    rows += [(100, [], vectors(2)), (101, None, vectors(2)), (102, [[0.0] * 5], vectors(1))]
    df = spark.createDataFrame(rows, "id long, ref array<array<float>>, pred array<array<float>>")

    def cos(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    for r in summary.with_token_match(df, "ref", "pred").collect():
        if not r["ref"]:
            assert (r["match_precision"], r["match_recall"], r["match_f1"]) == (0, 0, 0)
            continue
        p = sum(max(cos(x, y) for y in r["ref"]) for x in r["pred"]) / len(r["pred"])
        q = sum(max(cos(x, y) for y in r["pred"]) for x in r["ref"]) / len(r["ref"])
        assert (r["match_precision"], r["match_recall"]) == pytest.approx((p, q), abs=1e-6)
        assert r["match_f1"] == pytest.approx(2 * p * q / (p + q) if p + q else 0, abs=1e-6)


def test_token_match_in_blocks():
    import numpy as np

    rng = np.random.default_rng(0)
    ref, pred = rng.normal(size=(13, 4)), rng.normal(size=(29, 4))
    assert summary._greedy(ref, pred, block=5) == pytest.approx(summary._greedy(ref, pred, block=100))


def test_job(spark):
    df = spark.createDataFrame(
        [("d", "m", "a b", "a b", [[1.0, 0.0]], [[1.0, 0.0]]), ("d", "m", "a b", "c d", [[1.0, 0.0]], [[0.0, 1.0]])],
        "dataset string, model string, reference string, prediction string, rv array<array<float>>, pv array<array<float>>",
    )
    row = jobs.score_summaries(df, vectors=("rv", "pv")).first()
    assert (row["rouge1"], row["rougeLsum"], row["match_f1"], row["pairs"]) == (0.5, 0.5, 0.5, 2)
