"""The pipeline's stages against brute force on the smallest table, and the rule that nothing else needs them."""

import ast
from pathlib import Path

import corpus_pipeline
from test_decontamination import brute as contaminated
from test_exact_dedup import brute as exact
from test_packing import check_packing
from test_simhash import brute_components, plain_fingerprint

from gradewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent.parent


def test_stages(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "packing":
            check_packing(after.collect(), before.values())
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r for r in after.collect()}
        assert all(before[i] == r for i, r in kept.items()) and len(kept) == after.count()
        if name == "language_id":
            assert {i for i, t in texts if any(c.isalpha() for c in t)} == set(kept)
        elif name == "exact_dedup":
            assert {i for i, _, _, k, _ in exact(texts) if k} == set(kept)
        elif name == "near_dedup":
            first = {}
            for i, t in sorted(texts, reverse=True):
                first[plain_fingerprint(t)] = i
            assert set(brute_components(first).values()) == set(kept)
        elif name == "decontamination":
            assert {r[0] for r in contaminated(texts, items) if not r[-1]} == set(kept)
        docs = after


def test_run_has_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < rows.select("doc_id").distinct().count() < 200


def test_edges_go_through_every_stage(spark, edges, nothing):
    for start in (edges, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_the_rest_does_not_import_this_subpackage():
    for file in (ROOT / "gradewell").rglob("*.py"):
        if "llm" in file.relative_to(ROOT / "gradewell").parts:
            continue
        names = [n.module or "" for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.ImportFrom)]
        names += [a.name for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Import) for a in n.names]
        assert not any("llm" in name.split(".") for name in names), file


def test_oracles_are_text():
    assert all(isinstance(sql, str) for sql in ORACLES.values()) and all(callable(q) for q in QUERIES.values())
