"""Quoted CSV by byte ranges against the multi-line reader, on files cut into many ranges."""

import random

import pytest
from pyspark.sql import types as T

from gradewell.sources import csv_ranges, tables

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of about 2,000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def value(rng, longest):
    alphabet = ["a", "b", " ", "é", '"', '""', "\n", "\n\n", ",", "word", "\r\n"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


def write(path, seed, rows, longest=40):
    rng = random.Random(seed)
    lines = [f'{i},{quoted(value(rng, longest))},{rng.choice(["pos", "", quoted("x,y")])}' for i in range(rows)]
    path.write_bytes(("n,text,label\n" + "\n".join(lines) + "\n").encode())


def multi_line(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))


def rows_of(df):
    return sorted(map(tuple, df.select("n", "text", "label").collect()), key=str)


def test_equals_the_multi_line_reader(spark, tmp_path, small_ranges):
    for seed in range(3):
        write(tmp_path / f"{seed}.csv", seed, 300)
    found = csv_ranges.quote_ranges(spark, [str(tmp_path)])
    assert len(found.inside) > 20 and found.crossed and not found.unbalanced and len(found.files) == 3
    ours = csv_ranges.read_quoted_csv(spark, [str(tmp_path)], SCHEMA)
    assert rows_of(ours) == rows_of(multi_line(spark, tmp_path)) and ours.count() == 900
    placed = ours.orderBy("_file", "_row").select("n").collect()
    assert [r[0] for r in placed] == list(range(300)) * 3
    assert csv_ranges._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 10


def test_records_longer_than_several_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "x.csv"
    long_text = "\n".join(f'line {i}, with "quotes"' for i in range(1_500))
    body = "".join(f"{i},{quoted(long_text if i % 3 == 1 else 'short')},l{i}\n" for i in range(8))
    path.write_text("n,text,label\n" + body, encoding="utf-8")
    assert rows_of(csv_ranges.read_quoted_csv(spark, [str(path)], SCHEMA)) == rows_of(multi_line(spark, path))


def test_small_cases(spark, tmp_path):
    for name, body in (("empty", ""), ("header", "n,text,label\n"), ("no_end", 'n,text,label\n1,"a\nb",c'), ("windows", 'n,text,label\r\n1,"a\r\nb",c\r\n'),
                       ("blank", 'n,text,label\n\n1,a,b\n   \n2,"",\n'), ("short", "n,text,label\n1,a\n2,a,b,c\n")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(body.encode())
        assert rows_of(csv_ranges.read_quoted_csv(spark, [str(path)], SCHEMA)) == rows_of(multi_line(spark, path)), name


def test_a_file_of_odd_quotes_is_read_whole(spark, tmp_path, small_ranges):
    (tmp_path / "good.csv").write_text('n,text,label\n1,"a\nb",x\n', encoding="utf-8")
    (tmp_path / "odd.csv").write_text('n,text,label\n2,5" disk,y\n3,c,z\n', encoding="utf-8")
    found = csv_ranges.quote_ranges(spark, [str(tmp_path)])
    assert [f.split("/")[-1] for f in found.unbalanced] == ["odd.csv"]
    got = rows_of(tables.read_csv(spark, str(tmp_path), SCHEMA, missing_to_null=False))
    assert got == [(1, "a\nb", "x"), (2, '5" disk', "y"), (3, "c", "z")]


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("label,n,text\n", encoding="utf-8")
    with pytest.raises(ValueError):
        csv_ranges.read_quoted_csv(spark, [str(tmp_path)], SCHEMA)
