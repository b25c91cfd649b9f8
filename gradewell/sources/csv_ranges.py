"""CSV with quoted newlines, read by many tasks per file.

Spark cuts a text file into byte ranges whose first and last lines are whole. Inside quotes a newline is part of a value, so a
range has to know whether it begins there. It does if the ranges before it hold an odd number of quotes:

1. One pass counts the quotes of each range, and a prefix sum per file gives every range its first state.
2. Each task walks its ranges with that state and puts the lines of a record together. What crosses a range's end comes out
   as fragments.
3. Fragments belong to the last record that began before them; they are gathered per record, and joined in order.

This holds for files in which quotes stand only around values and doubled inside them. A file with an odd number of quotes
is no such file and is read whole by one task.

Bounds: the driver holds one row per byte range and file, as the scan's own planning does; a task holds one record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.session import scratch_path

RECORD, BEGUN, WITHIN, ENDED = range(4)
# A row number is the file's number and the byte offset of its range, plus the record's place in the range: records of a file
# ascend, since a record has at least one byte.
OFFSET_BITS = 44
_OUT = "kind int, row long, begins long, record string"
_OUT_NAMES = ["kind", "row", "begins", "record"]


@dataclass(frozen=True)
class Ranges:
    """What one counting pass finds: files in order, the state of each range, and what needs another way."""

    files: list[str]
    headers: list[str]
    inside: dict[tuple[int, int], tuple[int, bool]]  # (hash of the path, offset) to (file number, begins inside quotes)
    unbalanced: list[str]
    crossed: bool


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"),
        F.col("_metadata.file_path").alias("path"), "value")


def quote_ranges(spark: SparkSession, paths: Sequence[str]) -> Ranges:
    """Count quotes per byte range and sum them up along each file."""
    value = F.col("value")
    first = F.when(F.col("begins") == 0, F.col("at"))
    counted = _lines(spark, paths).withColumn("at", F.monotonically_increasing_id()).groupBy("file", "path", "begins").agg(
        F.sum(F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"), F.min_by("value", first).alias("header"))
    files, headers, inside, unbalanced, crossed, total = [], [], {}, [], False, 0
    last = None
    for row in sorted(counted.collect(), key=lambda r: (r["path"], r["begins"])):
        if row["path"] != last:
            if last is not None and total % 2:
                unbalanced.append(last)
            last, total = row["path"], 0
            files.append(last)
            headers.append((row["header"] or "").replace("﻿", ""))
        inside[row["file"], row["begins"]] = (len(files) - 1, bool(total % 2))
        crossed |= bool(total % 2)
        total += row["quotes"]
    if last is not None and total % 2:
        unbalanced.append(last)
    return Ranges(files, headers, inside, unbalanced, crossed)


class _Walk:
    """The lines of one byte range, batch after batch."""

    def __init__(self, number: int, begins: int, inside: bool):
        self.base, self.begins = (number << OFFSET_BITS) + begins, begins
        self.inside, self.headless, self.place = inside, inside, 0
        self.open: list[pa.Array] = []

    def _joined(self) -> str:
        return "\n".join(x.as_py() for part in self.open for x in part)

    def feed(self, values: pa.Array) -> list[tuple[list[int], list[int], pa.Array | list[str]]]:
        """(kinds, rows, records) found complete with these lines."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2
        before = np.r_[int(self.inside), after[:-1]]
        starts, out = np.flatnonzero(before == 0), []
        head = int(starts[0]) if len(starts) else len(values)
        if head:
            self.open.append(values[:head])
            if after[head - 1] == 0:
                if self.headless:
                    out.append(([ENDED], [self.base], [self._joined()]))
                else:
                    out.append(([RECORD], [self.base + self.place], [self._joined()]))
                    self.place += 1
                self.headless, self.open = False, []
        if len(starts):
            ends = np.r_[starts[1:], len(values)]
            if after[-1]:
                self.open = [values[int(starts[-1]) :]]
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                offsets = pa.array(np.r_[starts, ends[-1:]].astype(np.int32) - starts[0], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, values[int(starts[0]) : int(ends[-1])])
                out.append(([RECORD] * len(starts), list(range(self.base + self.place, self.base + self.place + len(starts))),
                            pc.binary_join(lists, "\n")))
                self.place += len(starts)
        self.inside = bool(after[-1])
        return out

    def end(self) -> list[tuple[list[int], list[int], list[str]]]:
        if not self.open:
            return []
        kind, row = (WITHIN, self.base) if self.headless else (BEGUN, self.base + self.place)
        return [([kind], [row], [self._joined()])]


def _records(batches: Iterable[pa.RecordBatch], inside, fragments: bool) -> Iterator[pa.RecordBatch]:
    """Complete records, or (``fragments``) only what crosses the ends of ranges."""
    walk, key = None, None

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        for kinds, numbers, records in found:
            if (kinds[0] == RECORD) != fragments:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(numbers, pa.int64()), pa.array([walk.begins] * len(kinds), pa.int64()),
                     records if isinstance(records, pa.Array) else pa.array(records, pa.string())], names=_OUT_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, begins = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.r_[0, np.flatnonzero((files[1:] != files[:-1]) | (begins[1:] != begins[:-1])) + 1, batch.num_rows]
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            here = (int(files[start]), int(begins[start]))
            if here != key:
                if walk is not None:
                    yield from rows(walk.end())
                if here not in inside.value:
                    raise RuntimeError("the file was cut into other byte ranges than when its quotes were counted; read it again")
                number, quoted = inside.value[here]
                walk, key = _Walk(number, here[1], quoted), here
            yield from rows(walk.feed(batch.column(2)[start:stop].cast(pa.string())))
    if walk is not None:
        yield from rows(walk.end())


def _crossing(parts: DataFrame) -> DataFrame:
    """(row, record) of the records that cross ranges, from their fragments.

    A fragment's record is the last one begun at or before it in the file. That is found on the fragments' row numbers
    alone, two per range; the texts are joined afterwards.
    """
    spark = parts.sparkSession
    path = scratch_path(spark, "csv-fragments")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    order = Window.partitionBy(F.shiftright("row", OFFSET_BITS)).orderBy("begins", F.desc("kind"))
    owner = F.last(F.when(F.col("kind") == BEGUN, F.col("row")), ignorenulls=True).over(order)
    owned = parts.select("kind", "row", "begins").withColumn("owner", owner)
    joined = parts.join(owned, ["kind", "row", "begins"])
    piece = F.struct("begins", F.negative("kind").alias("then"), "record")
    return joined.groupBy(F.col("owner").alias("row")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["record"]), "\n").alias("record"))


def csv_records(spark: SparkSession, paths: Sequence[str], found: Ranges | None = None) -> DataFrame:
    """(row, record): every record of the files as one text, the header of each file included, in no order."""
    found = found or quote_ranges(spark, paths)
    shared = spark.sparkContext.broadcast(found.inside)
    lines = _lines(spark, paths).select("file", "begins", "value")
    records = lines.mapInArrow(lambda b: _records(b, shared, False), _OUT).select("row", "record")
    if found.crossed:
        records = records.unionByName(_crossing(lines.mapInArrow(lambda b: _records(b, shared, True), _OUT)))
    return records


def read_quoted_csv(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, check_header: bool = True,
    found: Ranges | None = None,
) -> DataFrame:
    """The columns of ``schema`` as the multi-line reader gives them, and ``_file`` and ``_row``.

    ``_row`` ascends along each file. With ``check_header`` every file's header has to name the columns in order.
    """
    found = found or quote_ranges(spark, paths)
    names = [f.name for f in schema.fields]
    if check_header:
        for file, header in zip(found.files, found.headers):
            if header_names(header)[: len(names)] != names:
                raise ValueError(f"the header of {unquote(file)} is {header!r}; expected {names}")
    plain = [f for f in found.files if f not in set(found.unbalanced)]
    parts = []
    if plain:
        own = found if len(plain) == len(found.files) else quote_ranges(spark, [unquote(f) for f in plain])
        body = csv_records(spark, [unquote(f) for f in plain], own).where(F.col("row").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)) != 0)
        # Files with line ends of two characters have them inside values too; those are read as one.
        record = F.regexp_replace(F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record")), r"\r$", "")
        cells = F.from_csv(record, _ddl(schema), {"escape": '"'})
        table = [(i, file, header.endswith("\r")) for i, (file, header) in enumerate(zip(own.files, own.headers))]
        files = spark.createDataFrame(table, "number long, _file string, crlf boolean")  # one row per file
        kept = body.where(F.regexp_replace("record", r"\r$", "") != "").withColumn("number", F.shiftright("row", OFFSET_BITS))
        named = kept.join(F.broadcast(files), "number")
        parts.append(named.select(cells.alias("_cells"), "_file", F.col("row").alias("_row")).select("_cells.*", "_file", "_row"))
    if found.unbalanced:
        reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        whole = reader.csv([unquote(f) for f in found.unbalanced])
        parts.append(whole.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def header_names(header: str) -> list[str]:
    """Names in a header line."""
    return next(csv.reader([header.rstrip("\r")]), [])
