"""Base counts by brute force, measures against the tokenizers, verdicts on planted texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gradewell.llm import fertility


@pytest.fixture(scope="module")
def vocabularies():
    return fertility.Vocabularies(fertility.tokenizer_path(fertility.PIECES), fertility.tokenizer_path(fertility.BYTE_TOKENS))


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_base_counts(spark, documents, edges, nothing):
    for docs in (documents, edges):
        want = sorted((str(r["doc_id"]), *base(r["text"])) for r in docs.collect())
        rows = fertility.judge(docs).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == want
        assert not any(r["kept"] for r in rows if r["base_failed"])
    assert fertility.judge(nothing).count() == 0


def test_repeated_windows_by_brute_force(vocabularies):
    rng = random.Random(2)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randint(0, 40)) if rng.random() < 0.5 else rng.choices("ab", k=8) * rng.randint(0, 4)
        text = " ".join(words)
        vocabularies.learn(set(words))
        assert fertility.repeated_words(vocabularies.of(words)) == base(text)[4]


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(fertility, "_FACTOR", 1 << 32)  # only the first two words count
    ids = np.array([1, 2, *range(10, 20), 1, 2, *range(30, 40)])
    assert fertility.repeated_words(ids) == 0
    assert fertility.repeated_words(np.r_[ids, ids[:9]]) == 18


def test_words_learned_in_parts_keep_their_pieces(vocabularies, monkeypatch):
    """Piece ids lie in one array, and counts of a text are sums over it; words and long ones may be forgotten between texts."""
    monkeypatch.setattr(fertility, "_REMEMBERED", 40)
    rng = random.Random(4)
    for i in range(60):
        words = ["".join(rng.choices("abcdé中", k=rng.randint(1, 9))) for _ in range(30)] + ["x" * 500] * (i % 3 == 0)
        vocabularies.learn(set(words))
        ids, sizes = vocabularies.pieces_at(vocabularies.of(words))
        want = [vocabularies.pieces.encode(w) for w in words]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        n, per_piece, *_ = fertility.measures(sum(map(len, words)), vocabularies.of(words), vocabularies)
        assert n == len(ids) and math.isclose(per_piece, sum(map(len, words)) / n)
    assert vocabularies.pieces_at(np.zeros(0, np.int64))[0].tolist() == []


def test_measures_are_the_tokenizers(spark, documents, vocabularies):
    rows = {r["doc_id"]: r for r in fertility.measure(documents).withColumnRenamed("id", "doc_id").collect()}
    for r in documents.limit(60).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        ids = [i for w in words for i in vocabularies.pieces.encode(w)]
        if not ids:
            continue
        got, chars = rows[r["doc_id"]], sum(map(len, words))
        assert got["n_tokens"] == len(ids) and math.isclose(got["chars_per_piece"], chars / len(ids))
        assert math.isclose(got["byte_share"], sum(vocabularies.pieces.IsByte(i) for i in ids) / len(ids))
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        assert math.isclose(got["entropy"], entropy, abs_tol=1e-9)
        tokens = sum(len(vocabularies.byte_tokens.encode_ordinary(" " + w)) for w in words)
        assert math.isclose(got["chars_per_byte_token"], chars / tokens)


def test_scripts():
    assert [fertility.script_of(x) for x in ("", "12 !?", "word", "слово а b", "日本語のテキスト", "αβ ab", "한국어", "é")] == [
        "other", "other", "latin", "cyrillic", "kana", "greek", "hangul", "latin"]


def test_odd_texts_go_and_plain_ones_stay(spark):
    rng = random.Random(1)
    words = "time people water house place great small under light place story point world night river stone table".split()
    sane = [(i, " ".join(rng.choices(words, k=rng.randint(60, 90)))) for i in range(400)]
    odd = [(1_000, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz0123456789", k=9)) for _ in range(70))),
           (1_001, " ".join("".join(chr(rng.randrange(0x1D400, 0x1D7FF)) for _ in range(3)) + "ab" for _ in range(70))),
           (1_002, " ".join(rng.choices(words[:3], k=70)))]
    copies = [(2_000 + i, odd[0][1]) for i in range(600)]  # a group of copies moves no band
    rows = fertility.judge(spark.createDataFrame(sane + odd + copies, "doc_id long, text string")).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(rows) == 1_003 and set(range(400)) == kept


def test_small_scripts_are_judged_by_the_base_rules(spark):
    rows = [(1, " ".join(f"слово{i}" for i in range(30))), (2, " ".join(f"λέξη{i}" for i in range(30))), (3, "мало слов")]
    got = {r["doc_id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: True, 3: False}
