"""Language identification, quality and class language model: held-out figures, exact counts, edge cases."""

import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gradewell.llm import class_lm, common, language_id, quality

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def held_out(doc_id, folds, at):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == at


def test_language_of_held_out_documents(small):
    lang = {r["doc_id"]: r["lang"] for r in small.select("doc_id", "lang").collect()}
    rows = language_id.identify(small).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == held_out(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in unseen]) > 0.98


def test_language_edges(edges, nothing):
    found = language_id.identify(edges).collect()
    no_letter = {r["doc_id"] for r in edges.collect() if not any(c.isalpha() for c in r["text"] or "")} - {4, None}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} - {4, None} == no_letter
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und") and len(found) == edges.count()
    kept = language_id.keep_identified(edges)
    assert kept.columns == edges.columns and kept.where("text IS NULL OR text = ''").count() == 0
    assert language_id.identify(nothing).count() == 0
    unlabelled = edges.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_documents_with_letters_stay_without_labels(edges):
    unlabelled = edges.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    kept = language_id.keep_identified(unlabelled)
    with_letters = [r["text"] for r in edges.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert kept.columns == unlabelled.columns and sorted(r["text"] for r in kept.collect()) == sorted(with_letters)


def test_copies_are_drawn_one_by_one(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "concat('l', id % 10) AS lang", "concat('word', chr(97 + int(id % 10))) AS text")
    model = language_id.train(docs, sample=100)
    assert len(model.languages) == 10 and all(model.predict(f"word{chr(97 + i)}")[0] == f"l{i}" for i in range(10))


def test_units_reach_the_driver_as_arrow_columns(spark, monkeypatch):
    """Rows and dictionaries of all units took most of the driver's memory."""
    docs = spark.createDataFrame(
        [(i, "ab"[i % 2], f"wort{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]} gleich {'nur' if i % 2 else 'auch'}") for i in range(400)],
        "doc_id long, lang string, text string")
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(rows := collect(df)) or rows)
    monkeypatch.setattr(language_id, "MODEL_ROWS", 50)
    model = language_id.train(docs)
    assert max(map(len, collected)) <= 2 * (language_id.LONGEST_GRAM + 1)
    # The most frequent words, among equals those that sort first.
    counts = Counter(w for r in docs.toLocalIterator() for w in r["text"].split())
    assert set(model.units[0]) == set(sorted(counts, key=lambda w: (-counts[w], w))[:50])
    row = model.table[model.units[0]["gleich"]]
    assert model.predict("nur")[0] == "b" and model.predict("auch")[0] == "a" and abs(row[0] - row[1]) < 1e-5


def test_frequencies_of_maps():
    kind = pa.map_(pa.string(), pa.int64())
    maps = pa.chunked_array([pa.array([[("x", 9)], [("b", 2), ("a", 1)], []], kind)[1:], pa.array([[("b", 3)]], kind)])
    assert language_id._frequencies(maps, ["a", "b", "x"]).tolist() == [[1, 2, 0], [0, 0, 0], [0, 3, 0]]


def test_unseen_words_fall_back_to_grams():
    table = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.7, 0.3]], np.float32))
    model = language_id.Model(["aa", "bb"], [{"word": 0}, {"q": 1}, {}, {}, {"\x02zur": 2}], table)
    assert model.predict("word")[0] == "aa"
    assert model.predict("qq")[0] == "bb"  # down to single characters
    assert model.predict("zur")[0] == "aa"  # by its first 4-gram
    assert model.predict("12 3!") == ("und", 0.0)


def test_quality_of_held_out_documents(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.score(small, labels).collect()]
    assert len(rows) == small.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.9
    good = [r["score"] for r in unseen if truth[r["doc_id"]]]
    bad = [r["score"] for r in unseen if not truth[r["doc_id"]]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.85


def test_quality_edges(spark, edges, nothing):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(1, None, 0), (None, 1, 0)], schema)
    assert quality.score(edges, labels).count() == edges.count() and quality.score(nothing, labels).count() == 0
    assert {r["score"] for r in quality.score(edges, labels.limit(0)).collect()} == {0.5}
    one = quality.score(edges, labels.where("quality = 1")).collect()
    assert len(one) == edges.count() and all(0 <= r["score"] <= 1 for r in one)


def test_index_vectors_depend_on_the_unit_alone():
    a, b = quality.index_vector("word"), quality.index_vector("word")
    assert (a[0] == b[0]).all() and len(set(a[0].tolist())) == quality.NONZERO and a[1].sum() == 0
    assert quality.units_of("HELLO World, it's 12!!") == ["hello", "\x01upper", "world", "\x01capital", ",", "it", "'", "s", "12", "!!"]


def check_base(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held_out(d, 7, 2) for w in ws)
    total, types = sum(counts.values()), len(counts)
    want = sorted(((d, held_out(d, 7, 2), len(ws), sum(counts[w] > 0 for w in ws), total,
                    round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), 4)) for d, ws in tokens), key=repr)
    got = class_lm.score_texts(df).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == want
    return got


def test_language_model_counts_and_perplexity(small, edges, nothing):
    rows = check_base(small)
    unseen = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in unseen)
    assert sum(r["score"] - r["base_score"] for r in unseen) / tokens > 0.15
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in check_base(edges))
    assert class_lm.score_texts(nothing).count() == 0


def test_small_chunks_give_equal_scores(documents, monkeypatch):
    def scores():
        rows = class_lm.score_texts(documents.coalesce(1)).select("doc_id", "base_score", "score").collect()
        return {r["doc_id"]: (round(r["base_score"], 6), round(r["score"], 6)) for r in rows}

    whole = scores()
    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 30_000)
    assert scores() == whole


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    words, bands = 40, 3
    bigrams = np.zeros((words + bands, words + bands))
    kind = np.arange(words) >= 26
    for _ in range(4000):  # words of one kind are followed by words of the other
        a = int(rng.integers(words))
        bigrams[a, int(rng.choice(np.flatnonzero(kind != kind[a])))] += 1
    member = class_lm.exchange(bigrams, words, 2)

    def information(m):
        hot = np.eye(int(m.max()) + 1)[m]
        grid = hot.T @ bigrams @ hot
        f = class_lm._information
        return f(grid).sum() - f(grid.sum(axis=0)).sum() - f(grid.sum(axis=1)).sum()

    start = np.r_[np.arange(words) * 2 // words, 2 + np.arange(bands)]
    assert information(member) > information(start)
    assert len({(bool(kind[i]), int(member[i])) for i in range(words)}) == 2


def brute_score(rows, sweeps):
    """Scores of texts, written out word by word: seeds by exchange, all others placed by their neighbours, two-step products."""
    texts = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    trained = [ws for d, ws in texts if not held_out(d, 7, 2)]
    counts = Counter(w for ws in trained for w in ws)
    classes = class_lm.class_count(len(counts))
    seeds = [b""] + sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: class_lm.SEEDS * classes - 1]
    symbol = {w: i for i, w in enumerate(seeds)}
    heads, bands, prior = len(seeds), class_lm.BANDS, class_lm.PRIOR

    def of(word):
        return symbol.get(word, heads + counts[word].bit_length())

    def grid():
        table = np.zeros((heads + bands, heads + bands))
        for ws in trained:
            for a, b in zip([b"", *ws], ws):
                table[of(a), of(b)] += 1
        return table

    for sweep in range(sweeps):
        table = grid()
        member = class_lm.exchange(table, heads, classes) if sweep == 0 else np.arange(heads + bands)
        total = int(member.max()) + 1
        by_class = np.zeros((total, total))
        for (a, b), n in np.ndenumerate(table):
            by_class[member[a], member[b]] += n
        size = by_class.sum(axis=0)
        share = (size + 1) / (size + 1).sum()
        chance = [[math.log((by_class[a, b] + prior * share[b]) / (by_class[a].sum() + prior)) for b in range(total)] for a in range(total)]
        gains = {w: np.zeros(classes) for w in counts if counts[w] >= class_lm.MIN_COUNT and w not in seeds}
        for ws in trained:
            for a, w, b in zip([b"", *ws], ws, [*ws[1:], b""]):
                if w in gains:
                    before, after = member[of(a)], member[of(b)]
                    gains[w] += [chance[k][after] + chance[before][k] - math.log(max(size[k], 1)) for k in range(classes)]
        placed = {w: int(np.argmax(np.round(g, 6))) for w, g in gains.items()}
        symbol = ({w: int(member[symbol[w]]) for w in seeds}) | placed
        heads = classes
    weights = class_lm.log_weights(grid(), np.arange(heads + bands), len(counts))
    return [(d, sum(weights[of(a), of(b)] + math.log10(max(counts[b], 1)) for a, b in zip([b"", *ws], ws))) for d, ws in texts]


@pytest.mark.parametrize("sweeps", [1, 2])
def test_scores_of_the_whole_vocabulary_by_brute_force(spark, edges, documents, sweeps, monkeypatch):
    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 20_000)  # words meet their contexts from many chunks
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").limit(120).collect()]
    rows += [(900_001, None), (900_002, ""), (None, rows[0][1]), rows[1], rows[1], (900_003, "a b a b c c d zzz")]
    got = class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sweeps=sweeps).collect()
    want = sorted(((d, round(s, 4)) for d, s in brute_score(rows, sweeps)), key=repr)
    assert sorted(((r["doc_id"], round(r["score"], 4)) for r in got), key=repr) == want


def test_words_are_placed_alike_however_their_rows_are_cut():
    rng = np.random.default_rng(4)
    gains = np.log(rng.random((30, 5)))
    words = np.sort(rng.integers(0, 40, 300))
    entries = []
    for _ in words:
        one = np.zeros(int(rng.integers(0, 4)), class_lm._ENTRY)
        one["key"], one["n"] = rng.integers(0, 30, len(one)), rng.integers(1, 9, len(one))
        entries.append(one)
    want = {}
    for word, one in zip(words, entries):
        want[word] = want.get(word, np.zeros(5)) + (gains[one["key"]] * one["n"][:, None]).sum(axis=0)
    best = [int(np.argmax(np.round(want[w], 6))) for w in words]
    for rows, block in ((300, 1_000), (300, 3), (7, 1_000), (1, 1), (50, 5)):
        batches = [
            pa.RecordBatch.from_arrays([
                pa.array(words[i : i + rows]), pa.array(np.arange(300)[i : i + rows]), pa.array(np.arange(300, dtype=np.int32)[i : i + rows]),
                pa.array([e.tobytes() for e in entries[i : i + rows]], pa.binary()),
            ], names=["word_id", "chunk", "local", "contexts"]) for i in range(0, 300, rows)
        ]
        out = pa.Table.from_batches(list(class_lm._place_batches(batches, gains, block)))
        assert out["chunk"].to_pylist() == out["local"].to_pylist() == list(range(300)) and out["class"].to_pylist() == best


def test_words_with_many_contexts_and_rows_of_a_slice():
    rng = np.random.default_rng(5)
    gains = np.log(rng.random((50, 7)))
    words = np.repeat(np.arange(12), 5)
    entries = []
    for i, _ in enumerate(words):  # some words have none, some few, some more than are summed together
        one = np.zeros([0, 2, class_lm._MANY, 40][i // 5 % 4], class_lm._ENTRY)
        one["key"], one["n"] = rng.integers(0, 50, len(one)), rng.integers(1, 70_000, len(one))
        entries.append(one)
    want = [int(np.argmax(np.round(sum((gains[e["key"]] * e["n"][:, None]).sum(axis=0) for e in entries[w * 5 : w * 5 + 5]), 6))) for w in words]
    whole = pa.RecordBatch.from_arrays([
        pa.array(words), pa.array(np.arange(60)), pa.array(np.arange(60, dtype=np.int32)), pa.array([e.tobytes() for e in entries], pa.binary()),
    ], names=["word_id", "chunk", "local", "contexts"])
    for block in (1, 64, 16_000):
        out = pa.Table.from_batches(list(class_lm._place_batches([whole.slice(0, 17), whole.slice(17, 1), whole.slice(18)], gains, block)))
        assert out["chunk"].to_pylist() == list(range(60)) and out["class"].to_pylist() == want


def test_words_of_all_texts_are_numbered_at_once():
    texts = [b"", b" \t\n\x0b\x0c\r", b"One one\x00 TWO", "Él él ÉL\u00a0x".encode(), b"", b"  two\nthree  ", b"\x1cone \xff\xfe"]
    for some in (texts, texts[:1], texts[:2], texts[2:3], texts * 3):
        numbers, lengths, words = class_lm._numbered(some)
        spelled = [words[i].as_py() for i in numbers.tolist()]
        want = [t.lower().split() + [b""] for t in some]
        assert spelled == [w for ws in want for w in ws] and lengths.tolist() == [len(ws) for ws in want]
        assert words[0].as_py() == b"" and len(set(words.to_pylist())) == len(words)


def least_seconds(run, times=3):
    taken = []
    for _ in range(times):
        began = time.process_time()
        run()
        taken.append(time.process_time() - began)
    return min(taken)


def test_placing_takes_little_more_time_than_reading_the_gains():
    """Sums of a few contexts each, class by class, took over ten times as long."""
    rng = np.random.default_rng(6)
    gains, rows = np.log(rng.random((960, 108))), 20_000
    entries = np.zeros(rows * 5, class_lm._ENTRY)
    entries["key"], entries["n"] = rng.integers(0, 960, len(entries)), 1
    packed = entries.tobytes()
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(rows) // 5), pa.array(np.arange(rows)), pa.array(np.arange(rows, dtype=np.int32)),
        pa.array([packed[i : i + 30] for i in range(0, len(packed), 30)], pa.binary()),
    ], names=["word_id", "chunk", "local", "contexts"])
    keys = entries["key"].reshape(-1, 1000)
    plain = least_seconds(lambda: [gains[some].sum() for some in keys])
    assert least_seconds(lambda: list(class_lm._place_batches([batch], gains))) < 4 * plain


def test_contexts_go_with_their_sweep(documents, monkeypatch):
    """The contexts of both sweeps, the largest tables but one, stood on disk to the end."""
    files, write = {}, class_lm.hand_over

    def recorded(df, name, **how):
        out = write(df, name, **how)
        files[name] = [f.removeprefix("file://") for f in out.inputFiles()]
        return out

    monkeypatch.setattr(class_lm, "hand_over", recorded)
    assert class_lm.score_texts(documents).count() == documents.count()
    left = {name for name, found in files.items() if any(os.path.exists(f) for f in found)}
    assert left == set(files) - {"lm-contexts-0", "lm-contexts-1"} and len(files) == 7


def test_tables_of_words_have_a_row_for_each_chunk_and_block(documents, monkeypatch):
    """There was a row for each word of a chunk, which Spark wrote, shuffled and sorted in every sweep."""
    rows, write = {}, class_lm.hand_over

    def recorded(df, name, **how):
        out = write(df, name, **how)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(class_lm, "hand_over", recorded)
    assert class_lm.score_texts(documents.coalesce(1)).count() == documents.count()
    blocks = common.partitions_for(documents.sparkSession, 0, 1)
    assert rows["lm-chunks"] <= documents.count() + blocks and all(rows[f"lm-classes-{k}"] <= blocks for k in range(2))
    named = min(class_lm.SEEDS * class_lm.class_count(10**6), 2_000)
    assert rows["lm-counts"] <= blocks * (named + 3) and all(rows[f"lm-contexts-{k}"] <= blocks + 1 for k in range(2))


def block_of(chunks, dealt=5):
    """Chunks of (word, local, count) as a block of the vocabulary."""
    return pa.table({
        "chunk": pa.array([k for k, _ in chunks]), "block": pa.array([dealt] * len(chunks), pa.int32()),
        "words": pa.array([b"".join(w for w, _, _ in ws) for _, ws in chunks], pa.binary()),
        "sizes": pa.array([np.array([len(w) for w, _, _ in ws], "<u4").tobytes() for _, ws in chunks], pa.binary()),
        "local": pa.array([np.array([i for _, i, _ in ws], "<i4").tobytes() for _, ws in chunks], pa.binary()),
        "n": pa.array([np.array([n for _, _, n in ws], "<i8").tobytes() for _, ws in chunks], pa.binary()),
    })


@pytest.mark.parametrize("most", [1, 3, 4, 100])
def test_words_of_a_block_are_counted_over_its_chunks(most):
    chunks = [(9, [(b"", 0, 2**40), (b"the", 1, 3), (b"b", 7, 0), (b"zz", 4, 1)]), (2, [(b"c", 3, 1), (b"the", 2, 4), (b"b", 1, 0)]), (4, [(b"a", 1, 1)])]
    out = class_lm._count_block(block_of(chunks), most)
    want = Counter()
    for _, words in chunks:
        want.update({w: n for w, _, n in words})
    slices = out.filter(pc.is_valid(out["chunk"])).to_pylist()
    number = {}
    for row, (chunk, words) in zip(slices, chunks):
        assert row["chunk"] == chunk and np.frombuffer(row["local"], "<i4").tolist() == [i for _, i, _ in words]
        assert np.frombuffer(row["c"], "<i8").tolist() == [want[w] for w, _, _ in words]
        for (w, _, _), place in zip(words, np.frombuffer(row["place"], "<i4").tolist()):
            assert number.setdefault(w, place) == place
    assert len(set(number.values())) == len(number)
    totals = out.filter(pc.is_valid(out["types"])).to_pylist()
    assert [(r["types"], r["tokens"]) for r in totals] == [(sum(n > 0 for n in want.values()), sum(want.values()))]
    # The frequent words, ties to the word lower in byte order, and always the end.
    named = [(r["word"], r["word_id"], r["word_c"]) for r in out.filter(pc.is_valid(out["word"])).to_pylist()]
    top = sorted((w for w in want if w and want[w]), key=lambda w: (-want[w], w))[:most]
    assert named == [(w, (5 << 32) + number[w], want[w]) for w in [*top, b""]]


def test_a_block_without_the_end_or_training_words():
    out = class_lm._count_block(block_of([(1, [(b"x", 2, 0)]), (0, [(b"x", 1, 0), (b"y", 3, 0)])]), 4)
    assert not out["word"].drop_null().to_pylist() and out["types"].drop_null().to_pylist() == out["tokens"].drop_null().to_pylist() == [0]


def test_words_of_a_block_are_placed_over_its_chunks():
    rng = np.random.default_rng(8)
    gains = np.log(rng.random((40, 6)))
    rows, want = [], np.zeros((30, 6))
    for chunk in (7, 1, 4):
        place = np.sort(rng.choice(30, 20, replace=False)).astype("<i4")
        sizes = rng.integers(0, 4, 20).astype("<u4")
        entries = np.zeros(int(sizes.sum()), class_lm._ENTRY)
        entries["key"], entries["n"] = rng.integers(0, 40, len(entries)), rng.integers(1, 9, len(entries))
        np.add.at(want, np.repeat(place, sizes), gains[entries["key"]] * entries["n"][:, None])
        rows.append({"block": 3, "chunk": chunk, "place": place.tobytes(), "local": rng.permutation(20).astype("<i4").tobytes(),
                     "sizes": sizes.tobytes(), "contexts": entries.tobytes()})
    found = pa.Table.from_pylist(rows)
    got = {r["chunk"]: r for r in class_lm._place_block(found, gains).to_pylist()}
    best = np.argmax(np.round(want, 6), axis=1)
    assert set(got) == {1, 4, 7}
    for row in rows:
        assert got[row["chunk"]]["local"] == row["local"]
        assert np.frombuffer(got[row["chunk"]]["class"], "<i4").tolist() == best[np.frombuffer(row["place"], "<i4")].tolist()


def test_shuffles_go_with_their_queries(spark, monkeypatch):
    """All shuffles of the run stood on disk beside its tables until the driver collected garbage."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    write = class_lm.hand_over
    monkeypatch.setattr(class_lm, "hand_over", lambda df, name, **how: seen.append((spark.conf.get(key), how)) or write(df, name, **how))
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"a b c{i % 3} d") for i in range(20)], "doc_id long, text string")
    assert class_lm.score_texts(docs).count() == 20
    assert len(seen) > 4 and all(x == ("true", {"compression": "zstd"}) for x in seen) and spark.conf.get(key) == before


def test_classes_grow_with_the_vocabulary():
    assert [class_lm.class_count(n) for n in (0, 1_000, 370_000, 10**9)] == [8, 10, 72, 1000]


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    seeds, classes = 64, 16
    bigrams = rng.integers(0, 5, (seeds + class_lm.BANDS, seeds + class_lm.BANDS)).astype(float)
    member = class_lm.exchange(bigrams, seeds, classes, sweeps=1)
    types = 9_999
    weights = class_lm.log_weights(bigrams, member, types)
    hot = np.eye(int(member.max()) + 1)[member]
    count = np.maximum(bigrams.sum(axis=0) @ hot, 1)
    count[weights.shape[0] - class_lm.BANDS] = types + 1
    assert np.allclose((10**weights * count).sum(axis=1), 1)
