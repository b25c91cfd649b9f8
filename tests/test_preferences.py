"""Preference pairs from small instruction files."""

import json

import pytest

from gradewell.operators import preferences
from gradewell.sources import tables

A = [{"instruction": " How? ", "output": "Think. "}, {"instruction": "", "output": "x"},
     {"instruction": "Why é", "output": "Logic \"q\""}, {"instruction": "left", "output": "over"}]
B = [{"instruction": "", "output": "Feel."}, {"instruction": "b", "output": "y"}, {"instruction": "Warum", "output": "Herz"}]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw files+x")
    for name, records in (("en_decision_thinking.json", A), ("en_decision_feeling.json", B), ("readme.json", [])):
        (path / name).write_text(json.dumps(records, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(path)


def test_files_become_records(spark, folder):
    rows = tables.read_instructions(spark, folder).collect()
    got = {(r["dimension"], r["subtype"], r["position"]): (r["instruction"], r["output"]) for r in rows}
    want = {("decision", s, i): (r["instruction"], r["output"]) for s, rs in (("thinking", A), ("feeling", B))
            for i, r in enumerate(rs)}
    assert got == want


def test_broken_file_fails(spark, tmp_path):
    (tmp_path / "en_decision_thinking.json").write_text('[{"instruction": "x", ', encoding="utf-8")
    with pytest.raises(Exception):
        tables.read_instructions(spark, str(tmp_path)).collect()


def test_flat(spark, folder):
    raw = tables.read_instructions(spark, folder)
    rows = preferences.flat_pairs(raw, "decision", "feeling").orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [(b["instruction"], b["output"], a["output"]) for a, b in zip(A, B)]
    assert preferences.flat_pairs(raw, "decision", "thinking", limit=2).count() == 2
    with pytest.raises(FileNotFoundError):
        preferences.flat_pairs(raw, "energy", "introversion")


def test_chat(spark, folder):
    raw = tables.read_instructions(spark, folder)
    a, b = (preferences.records_of(raw, "decision", s) for s in ("thinking", "feeling"))
    rows = preferences.chat_pairs(a, b).orderBy("preferred", "position").collect()

    def chat(user, assistant):
        return [{"role": "user", "content": user}, {"role": "assistant", "content": assistant}]

    got = [(json.loads(r["chosen"]), json.loads(r["rejected"]), r["score_chosen"], r["score_rejected"]) for r in rows]
    assert got == [
        (chat("How?", "Think."), chat("How?", "Feel."), 8, 1),
        (chat("Why é", 'Logic "q"'), chat("Why é", "Herz"), 8, 1),
        (chat("How?", "Feel."), chat("How?", "Think."), 8, 1),
        (chat("Warum", "Herz"), chat("Warum", 'Logic "q"'), 8, 1),
    ]
    assert "é" in rows[1]["chosen"]
