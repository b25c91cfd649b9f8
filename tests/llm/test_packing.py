"""Token ids against the tokenizer itself, packings against their laws."""

import zlib
from collections import defaultdict

import numpy as np

from gradewell.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def test_encoder_equals_the_tokenizer(documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    texts += ["Éau, ÉTRE. İx ſt Ǆa naïve ñ. a.b x., .,", "a\x0bb\x0cc\td\x1ce\x85f", "x <|endoftext|>y <|startoftext|>", "ΑΣ. Σ", "'s I'LL don't",
              "é ́a", "", "  ", "日本語 12 3.4 ﬁ", "a" * 5000]
    plain = tokenizer()
    got = packing._Encoder(packing.tokenizer_file()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def check_packing(rows, docs, capacity=packing.SEQUENCE_TOKENS):
    plain, by_doc = tokenizer(), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for d in docs:
        ids = np.array(plain.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d["doc_id"]].append((piece, at, len(part), zlib.crc32(part.tobytes())))
    got = {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()}
    assert got == {k: sorted(v) for k, v in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_documents(documents, edges, nothing):
    used, least = check_packing(packing.pack_documents(documents).collect(), documents.collect())
    assert used <= least + 1
    check_packing(packing.pack_documents(edges).collect(), edges.collect())
    assert packing.pack_documents(nothing).count() == 0


def test_groups_meet_again(documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    used, least = check_packing(packing.pack_documents(documents).collect(), documents.collect())
    assert used <= least + 3


def test_local_search_only_improves():
    rng = np.random.default_rng(1)
    for low, high in ((1000, 2500), (1400, 2100), (300, 2000), (1, 4096)):
        lengths = rng.integers(low, high, 1500)
        bins = packing.best_fit(lengths, 4096)
        better = packing.improve(lengths, bins, 4096)
        fill, before = np.bincount(better, lengths), np.bincount(bins, lengths)
        assert fill.max() <= 4096 and len(set(better.tolist())) <= len(set(bins.tolist()))
        assert (fill**2).sum() >= (before**2).sum()


def test_an_exchange_empties_a_bin():
    # Best fit decreasing needs three bins here; two suffice: 6+4 and 5+3+2.
    lengths, bins = np.array([6, 5, 4, 3, 2]), np.array([0, 1, 1, 0, 2])
    assert len(set(packing.improve(lengths, bins, 10).tolist())) == 2


def triplets(n, capacity=4096, seed=3):
    """Lengths that fill ``n`` bins exactly, three pieces each."""
    rng = np.random.default_rng(seed)
    first = rng.integers(capacity // 4 + 1, capacity // 2, n)
    second = rng.integers(capacity // 4, capacity // 2, n)
    second = np.minimum(second, capacity * 3 // 4 - first)
    return rng.permutation(np.r_[first, second, capacity - first - second])


def test_triplets_come_close_to_the_bound():
    lengths = triplets(300)
    bins = packing.improve(lengths, packing.best_fit(lengths, 4096), 4096)
    assert np.bincount(bins, lengths).max() <= 4096
    assert len(set(bins.tolist())) <= 313


def test_small_tables_against_the_best_packing():
    def fewest(rest, gaps):
        if not rest:
            return len(gaps)
        tried = {g: i for i, g in enumerate(gaps) if g >= rest[0]}
        ways = [fewest(rest[1:], gaps[:i] + [g - rest[0]] + gaps[i + 1 :]) for g, i in tried.items()]
        return min([*ways, fewest(rest[1:], [*gaps, 20 - rest[0]])])

    rng = np.random.default_rng(5)
    found = best = 0
    for _ in range(60):
        lengths = rng.integers(3, 14, 8)
        found += len(set(packing.improve(lengths, packing.best_fit(lengths, 20), 20).tolist()))
        best += fewest(sorted(lengths.tolist(), reverse=True), [])
    assert best <= found <= best + 3


def test_all_pairs_of_a_bin_count():
    # 31 pieces in the bin; only the two shortest together fit the place of the single piece elsewhere.
    totals, parts = packing._totals(np.arange(10, 41))
    assert totals[0] == 10 and totals[-1] == 79 and set(range(21, 80)) <= set(totals.tolist())
    assert all(sum(p) == t for t, p in zip(totals.tolist(), parts))
    assert packing._totals(np.array([5, 5]))[0].tolist() == [5, 10] and packing._totals(np.array([5]))[0].tolist() == [5]


def test_other_tokenizers_are_refused():
    import public_tokenizers
    import pytest

    with pytest.raises(ValueError):
        packing._Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_come_on_request(documents):
    row = packing.pieces(documents, with_ids=True).first()
    assert len(row["ids"]) == 4 * row["length"] and zlib.crc32(bytes(row["ids"])) == row["ids_crc32"]
