"""Licence phrases against a plain scan; templates by example."""

import re

from gradewell.llm import license_scan as lic

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    out = []
    for doc, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        starts, labels = [], set()
        for phrase, label in lic.PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def test_base_columns_equal_brute_force(documents, edges, nothing):
    for df in (documents, edges):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        found = lic.scan(df).collect()
        assert sorted((tuple(r)[:6] for r in found), key=repr) == brute(rows)
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert lic.scan(nothing).count() == 0


def test_every_template_is_found_in_its_own_notice(spark):
    rows = [(i, f"Some words before. {notice.title()}; and words after.") for i, (notice, _) in enumerate(lic.TEMPLATES.values())]
    rows.append((99, "software and license, version and copy: words of notices in no order, free of public permission"))
    found = {r["doc_id"]: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(lic.TEMPLATES):
        assert label in found[i]["labels"].split(","), label
        assert found[i]["score"] > 0.99
    assert found[99]["labels"] == "" and found[99]["score"] == 0


def test_key_phrase_is_mandatory(spark):
    rows = [(1, "licensed under the apache license version 2 0"), (2, "licensed under the apache big license version 2 0")]
    found = {r["doc_id"]: r["labels"] for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "apache,apache-2.0", 2: ""}


def test_rows_that_repeat_are_one_file(spark):
    rows = [(1, "only the apache license here")] * 5 + [(2, "released under the mit license")] * 3
    found = lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 8 and {(r["doc_id"], r["n_base"], r["labels"], r["score"]) for r in found} == {
        (1, 1, "apache", 0.5), (2, 1, "mit,mit-notice", 1.0)}


def test_sql_says_the_same(spark, edges, tmp_path):
    import duckdb
    from oracle import difference

    from gradewell.llm.queries import ORACLES

    edges = edges.where("text IS NULL OR length(text) < 100000")
    edges.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert difference(lic.scan(edges), con, ORACLES["op1_license_scan"]) is None
