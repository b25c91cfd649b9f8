"""Resampled means and token matching of texts by brute force."""

import hashlib
import math
from collections import Counter

import numpy as np

from gradewell.operators import resample, token_match


def test_weights_are_poisson():
    drawn = resample.weights(np.arange(1, 20_001), 50)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.05
    share = [(drawn == k).mean() for k in range(4)]
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 0.01 for k, s in enumerate(share))
    # Replicates do not repeat each other.
    assert abs(np.corrcoef(drawn[:, 3], drawn[:, 4])[0, 1]) < 0.05


def test_means_and_intervals_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("d", m, i, float(x), None if i % 50 == 0 else float(y)) for m in ("a", "b") for i, (x, y) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "dataset string, model string, row_id long, s double, t double")
    got = {r["model"]: r for r in resample.resampled_means(df.repartition(5), ["model", "row_id"], ["s", "t"], replicates=40).collect()}
    for model in ("a", "b"):
        own = [r for r in rows if r[1] == model]
        numbers = np.array([int(hashlib.md5(f"{r[1]}|{r[2]}".encode()).hexdigest()[:8], 16) % resample.PRIME for r in own])
        for name, values in (("s", [r[3] for r in own]), ("t", [r[4] or 0.0 for r in own])):
            values, means = np.array(values), []
            for a, b in resample.factors(40):
                weight = np.array([sum((a * int(n) + b) % resample.PRIME >= t for t in resample.THRESHOLDS) for n in numbers])
                means.append((weight @ values) / weight.sum())
            assert math.isclose(got[model][name], values.mean(), abs_tol=1e-9) and got[model]["pairs"] == 300
            for side, point in (("low", 2.5), ("mid", 50), ("high", 97.5)):
                assert math.isclose(got[model][f"{name}_{side}"], np.percentile(means, point), abs_tol=1e-9)
            assert got[model][f"{name}_low"] < values.mean() < got[model][f"{name}_high"]


def test_an_empty_table_and_a_single_pair(spark):
    schema = "dataset string, model string, row_id long, s double"
    assert resample.resampled_means(spark.createDataFrame([], schema), ["row_id"], ["s"]).count() == 0
    row = resample.resampled_means(spark.createDataFrame([("d", "a", 1, 0.25)], schema), ["row_id"], ["s"]).first()
    assert (row["s"], row["s_low"], row["s_high"], row["pairs"]) == (0.25, 0.25, 0.25, 1)


def _brute(ref, pred, vectors, weights):
    def unit(token):
        x = np.array(vectors.get(token) or [0.0, 0.0])
        return x / np.linalg.norm(x) if np.linalg.norm(x) else x

    def side(own, others):
        total = sum(weights[t] * n for t, n in Counter(own).items())
        found = sum(weights[t] * n * max(unit(t) @ unit(o) for o in others) for t, n in Counter(own).items())
        return found / total if total else 0.0

    if not ref or not pred:
        return 0.0, 0.0, 0.0
    p, r = side(pred, ref), side(ref, pred)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_token_match_of_texts(spark):
    vectors = {"cat": [1.0, 0.2], "dog": [0.9, 0.4], "car": [-0.3, 1.0], "the": [0.5, 0.5], "zero": [0.0, 0.0]}
    texts = [("the cat", "The dog!"), ("a car, a cat", "the the the"), ("", "cat"), (None, None), ("zero cat", "car zero unknown"), ("dog", "dog")]
    rows = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(texts)], "row_id long, reference string, prediction string")
    table = spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")
    split = [[(t or "").lower().replace(",", "").replace("!", "").split() for t in pair] for pair in texts]
    refs = Counter(t for r, _ in split for t in set(r))
    for idf in (True, False):
        weights = {t: math.log((len(texts) + 1) / (refs[t] + 1)) if idf else 1.0 for pair in split for side in pair for t in side}
        got = {r["row_id"]: tuple(r)[1:] for r in token_match.match_texts(rows, ["row_id"], "reference", "prediction", table, idf).collect()}
        assert len(got) == len(texts)
        for i, (ref, pred) in enumerate(split):
            assert np.allclose(got[i], _brute(ref, pred, vectors, weights)), (i, idf)


def test_vectors_travel_once_per_chunk(spark, monkeypatch):
    """Equal scores whatever the chunks and the join; a chunk holds one row per distinct token, not one per pair."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    texts = [tuple(" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(2)) for _ in range(400)]
    rows = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(texts)], "row_id long, reference string, prediction string").repartition(2)
    lists = {w: [float(x) for x in rng.normal(size=2)] for w in words[:25]}
    table = spark.createDataFrame(list(lists.items()), "token string, vector array<float>")
    joined = []
    lookup = token_match.lookup_join
    monkeypatch.setattr(token_match, "lookup_join", lambda left, *a, **b: joined.append(left.count()) or lookup(left, *a, **b))
    # All pairs of a task in one chunk, then chunks of a few pairs with a shuffled join.
    found = []
    for step, most, limit in ((500, 1 << 17, 32 << 20), (3, 20, -1)):
        monkeypatch.setattr(token_match, "_STEP", step)
        monkeypatch.setattr(token_match, "CHUNK_VOCABULARY", most)
        monkeypatch.setattr("gradewell.plans.skew.BROADCAST_BYTES", limit)
        found.append({r["row_id"]: tuple(r)[1:] for r in token_match.match_texts(rows, ["row_id"], "reference", "prediction", table).collect()})
    assert joined[0] <= 2 * len(words)
    refs = Counter(t for r, _ in texts for t in set(r.split()))
    weights = {w: math.log((len(texts) + 1) / (refs[w] + 1)) for w in words}
    for i, (r, p) in enumerate(texts):
        want = _brute(r.split(), p.split(), {w: np.float32(x).tolist() for w, x in lists.items()}, weights)
        assert np.allclose(found[0][i], want) and np.allclose(found[1][i], want)
