"""Label sets of any size found in texts with multi-pattern automata.

An automaton of all labels reads a text once, whatever the labels' lengths, so the work is linear in the text and its
matches. Labels are cut by hash into parts of at most ``PART_CHARACTERS`` characters; a part is broadcast, and a worker builds
its automaton once. A single part, the usual case, needs no shuffle of texts. More parts each read the texts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.session import scratch_path

# An automaton takes some hundred bytes for each character of its labels.
PART_CHARACTERS = 1_000_000
_BUILT: dict[int, tuple] = {}


def _automaton(shared) -> tuple:
    """(automaton, labels, datasets of each label) of a broadcast part; a worker keeps the last one."""
    if id(shared) not in _BUILT:
        import ahocorasick

        by_label: dict[str, set[str]] = {}
        for dataset, label in shared.value:
            by_label.setdefault(label, set()).add(dataset)
        automaton, labels = ahocorasick.Automaton(), list(by_label)
        for number, label in enumerate(labels):
            automaton.add_word(label, number)
        automaton.make_automaton()
        _BUILT.clear()
        _BUILT[id(shared)] = shared, automaton, labels, [by_label[x] for x in labels]
    return _BUILT[id(shared)][1:]


def _found(batches: Iterable[pa.RecordBatch], shared, name: str) -> Iterator[pa.RecordBatch]:
    """Batches (dataset, text, ...) with the labels of its dataset that each text contains."""
    automaton, labels, datasets = _automaton(shared)
    for batch in batches:
        out = []
        for dataset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hits = {number for _, number in automaton.iter(text)} if text else ()
            out.append([labels[number] for number in hits if dataset in datasets[number]])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, name])


def label_parts(labels: DataFrame, part_characters: int = PART_CHARACTERS) -> Iterator[list[tuple[str, str]]]:
    """The distinct (dataset, label) rows in parts of bounded size; empty labels are in no text. One part is held at a time."""
    spark = labels.sparkSession
    path = scratch_path(spark, "labels")
    labels.select("dataset", F.col("label").cast("string").alias("label")).filter("dataset is not null and length(label) > 0").distinct().write.parquet(path)
    labels = spark.read.schema("dataset string, label string").parquet(path)
    total = labels.agg(F.sum(F.length("label") + 8)).first()[0] or 0
    parts = -(-total // part_characters)
    for part in range(parts):
        own = labels if parts == 1 else labels.filter(F.pmod(F.xxhash64("label"), F.lit(parts)) == part)
        yield [tuple(r) for r in own.collect()]


def find_labels(rows: DataFrame, labels: DataFrame, text: str, keep: list[str], part_characters: int = PART_CHARACTERS) -> DataFrame:
    """(dataset, keep..., label): one row for each row of ``rows`` and label(dataset, label) that its text contains."""
    spark = rows.sparkSession
    narrow = rows.select("dataset", F.col(text).cast("string").alias("_text"), *[F.col(c) for c in keep if c != "dataset"])
    kept = ["dataset", *[c for c in keep if c != "dataset"]]
    schema = T.StructType([*narrow.schema.fields, T.StructField("_labels", T.ArrayType(T.StringType()))])
    out = None
    for part in label_parts(labels, part_characters):
        shared = spark.sparkContext.broadcast(part)
        found = narrow.mapInArrow(lambda b, shared=shared: _found(b, shared, "_labels"), schema)
        found = found.select(*kept, F.explode("_labels").alias("label"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else narrow.select(*kept, F.lit("").alias("label")).limit(0)


def without_labels(rows: DataFrame, labels: DataFrame, text: str, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """The rows whose text contains no label of their dataset, with all columns; a missing text contains none."""
    spark = rows.sparkSession
    rest = rows.select(F.col("dataset").alias("_d"), F.col(text).cast("string").alias("_text"), "*")
    for part in label_parts(labels, part_characters):
        shared = spark.sparkContext.broadcast(part)
        schema = T.StructType([*rest.schema.fields, T.StructField("_labels", T.ArrayType(T.StringType()))])
        rest = rest.mapInArrow(lambda b, shared=shared: _found(b, shared, "_labels"), schema).filter(F.size("_labels") == 0).drop("_labels")
    return rest.drop("_d", "_text")
