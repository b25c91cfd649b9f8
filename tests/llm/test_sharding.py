"""Shards against their laws."""

import zlib

from gradewell.llm import sharding


def rows_of(df):
    return sharding.assign_shards(df).collect()


def check(rows, docs):
    want = sorted((d["doc_id"] if d["doc_id"] is not None else -1, len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want
    slots, sizes = {}, dict.fromkeys(range(sharding.SHARDS), 0)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return max(sizes.values()) - min(sizes.values())


def test_edges_and_empty(edges, nothing):
    check(rows_of(edges), edges.collect())
    assert rows_of(nothing) == []


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check(rows_of(docs), docs.collect()) < 1_000


def test_a_third_of_the_rows_is_cut_and_small_groups_are_not(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot ', 50) ELSE repeat(concat('w', id DIV 6, ' '), 40) END AS text")
    rows = rows_of(docs)
    assert check(rows, docs.collect()) < 4_000
    shards = {}
    for r in rows:
        shards.setdefault(r["text_crc32"], []).append(r["shard"])
    hot = max(shards.values(), key=len)
    assert len(hot) == 1000 and len(set(hot)) > 4
    assert sum(len(set(s)) > 1 for s in shards.values()) == 1


def test_overfull_ranges_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    docs = spark.range(5000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    check(rows_of(docs), docs.collect())


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("record.*").exceptAll(documents).count() == 0 and back.count() == documents.count()
    assert back.select("shard").distinct().count() == sharding.SHARDS
