"""Repair of malformed result files, line by line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.text import strip
from gradewell.schema import require_columns

# The line shapes the repairs accept.
LAST_TWO_WORDS = r"(?dU)^(.*?)(\s+)(\w+)\s+(\w+)\z"
INDEXED_LINE = (
    r'(?dU)^"?(\d+)[\s,]*(.*?)[\s,]+"?([01])"?[\s,]+"?'
    r'(positive|negative|neutral|Positive|Negative|Neutral)"?\z'
)
# A separator no line contains, so that the CSV reader yields whole lines and skips each file's header.
_NO_SEPARATOR = "\u0001\u0002\u0003"


def body_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The non-blank lines after the header of each file, as ``value``; large files are split."""
    return (
        spark.read.schema("value string")
        .option("header", True)
        .option("sep", _NO_SEPARATOR)
        .option("quote", "")
        .option("nullValue", "\u0000")
        .csv(path if isinstance(path, str) else list(path))
        .filter("value is not null")
    )


def file_headers(spark: SparkSession, path: str | Sequence[str]) -> dict[str, str]:
    """The first line of each file, without a byte-order mark, by the file's path; empty files have an empty one.

    Only first blocks are read. The driver holds one line per file, as the reader holds the list of files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    listed = spark.read.format("binaryFile").load(paths).select("path").collect()
    lines = (
        spark.read.text(paths)
        .filter("_metadata.file_block_start = 0")
        .select("_metadata.file_path", F.monotonically_increasing_id().alias("at"), "value")
    )
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("value")).collect()
    known = {unquote(r["file_path"]): r["value"].replace("﻿", "").strip() for r in first}
    return {r["path"]: known.get(unquote(r["path"]), "") for r in listed}


def by_header(headers: Mapping[str, str]) -> dict[str, list[str]]:
    """Files that share a header are read together."""
    groups: dict[str, list[str]] = {}
    for file, header in sorted(headers.items()):
        groups.setdefault(header, []).append(file)
    return groups


def split_bare_csv(lines: DataFrame, header: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """S3: lines cut at every comma under the header's names, and the lines whose number of cells differs.

    ``keep`` names further columns of ``lines`` that the rows keep.

    Lines without any comma are ignored. A wrong cell count would spoil the whole file in a strict reader;
    here those lines come back as the second table.
    """
    names = header.split(",")
    cells = lines.withColumn("value", strip("value")).filter(F.contains(F.col("value"), F.lit(",")))
    cells = cells.withColumn("_cells", F.split("value", ","))
    fits = F.size("_cells") == len(names)
    rows = cells.filter(fits).select(*[F.col("_cells")[i].alias(n) for i, n in enumerate(names)], *keep)
    return rows, cells.filter(~fits).select("value")


def read_bare_csv(spark: SparkSession, path: str, *required: str) -> tuple[DataFrame, DataFrame]:
    """S3 for files: rows and rejected lines, each file under its own header.

    Raises if a required column is in no header of some file that has one.
    """
    parts = [split_bare_csv(body_lines(spark, files), header)
             for header, files in by_header(file_headers(spark, path)).items() if header]
    if not parts:
        raise ValueError(f"no file with a header in {path}")
    rows = [require_columns(r, *required) for r, _ in parts]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return together, reduce(DataFrame.unionByName, [rejects for _, rejects in parts])


def split_last_words(lines: DataFrame) -> DataFrame:
    """The last two words of a line are answer and prediction, the rest is text; other lines are left out."""
    line = strip("value")
    part = {name: F.regexp_extract(line, LAST_TWO_WORDS, i) for name, i in (("text", 1), ("answer", 3), ("prediction", 4))}
    out = lines.filter(line.rlike(LAST_TWO_WORDS)).select(*[c.alias(n) for n, c in part.items()])
    return out.withColumn("text", strip("text"))


def split_indexed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idx, text, label and lowered prediction of well-formed lines, and the other lines."""
    line: Column = strip("value")
    parts = {name: F.regexp_extract(line, INDEXED_LINE, i + 1)
             for i, name in enumerate(("idx", "text", "label", "prediction"))}
    parts["prediction"] = F.lower(parts["prediction"])
    rows = lines.filter(line.rlike(INDEXED_LINE)).select(*[c.alias(n) for n, c in parts.items()])
    return rows, lines.filter(~line.rlike(INDEXED_LINE)).select("value")
