"""CSV and JSON readers."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions.text import null_tokens_to_null
from gradewell.registry import LabelTask
from gradewell.schema import INSTRUCTION, with_prediction
from gradewell.sources import lines
from gradewell.sources.csv_ranges import header_names, quote_ranges, read_quoted_csv


def _missing_to_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    strings = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[null_tokens_to_null(c).alias(c) if c in strings else F.col(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    multi_line: bool = True,
    missing_to_null: bool = True,
    check_header: bool = True,
) -> DataFrame:
    """CSV with a header, doubled quotes and (with ``multi_line``) quoted newlines.

    With ``multi_line`` large files are split at byte ranges that know whether they begin inside quotes
    (:mod:`gradewell.sources.csv_ranges`). Missing-value words become null (N2).
    """
    if multi_line:
        paths = [path] if isinstance(path, str) else list(path)
        df = read_quoted_csv(spark, paths, schema, check_header).select(*[f.name for f in schema.fields])
        return _missing_to_null(df, schema) if missing_to_null else df
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", not check_header)
    )
    df = reader.csv(list(path) if not isinstance(path, str) else path)
    return _missing_to_null(df, schema) if missing_to_null else df


def read_csv_trimmed(
    spark: SparkSession, path: str, multi_line: bool = True, missing_to_null: bool = True
) -> DataFrame:
    """CSV whose header may carry a byte-order mark and blanks around names; every column is text.

    All files of the path share the header of the first.
    """
    if multi_line:
        found = quote_ranges(spark, [path])
        names = [c.strip() for c in header_names(found.headers[0])] if found.headers else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = read_quoted_csv(spark, [path], schema, check_header=False, found=found).select(*names)
    else:
        df = spark.read.option("header", True).option("escape", '"').csv(path)
        names = [c.replace("﻿", "").strip() for c in df.columns]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = df.toDF(*names)
    return _missing_to_null(df, schema) if missing_to_null else df


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = INSTRUCTION) -> DataFrame:
    """Files that each hold one JSON array; adds file_name and the record's position in its file.

    Such a file is one JSON value and so is read by one task, record by record and never as one string; many files
    are read side by side. Large inputs belong in JSON lines with a position column.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    records = reader.json(list(path) if not isinstance(path, str) else path)
    decoded = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    tagged = records.select(
        F.col("_metadata.file_path").alias("_path"), decoded.alias("file_name"), F.monotonically_increasing_id().alias("_at"), "*"
    )
    place = F.row_number().over(Window.partitionBy("_path").orderBy("_at")) - 1  # rows of one file, as one task read them
    return tagged.select("file_name", place.cast("long").alias("position"), *[f.name for f in schema.fields])


def keys_from_name(df: DataFrame, file_name: Column | str = "file_name") -> DataFrame:
    """Dimension and subtype from ``lang_dimension_subtype.json``; names with fewer parts are left out."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    keyed = df.withColumn("_parts", parts).filter(F.size("_parts") >= 3)
    return keyed.withColumns({"dimension": F.col("_parts")[1], "subtype": F.col("_parts")[2]}).drop("_parts")


def read_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """All instruction files of a folder as (dimension, subtype, position, instruction, output)."""
    records = keys_from_name(read_json_array(spark, f"{folder.rstrip('/')}/*.json"))
    return records.select("dimension", "subtype", "position", "instruction", "output")


def read_instruction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """S5 for large inputs: each ``lang_dimension_subtype.json`` is a folder of JSON lines that have a position."""
    schema = T.StructType([T.StructField("position", T.LongType()), *INSTRUCTION.fields])
    found = spark.read.schema(schema).json(f"{folder.rstrip('/')}/*.json")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return keys_from_name(found.withColumn("file_name", name)).select(
        "dimension", "subtype", "position", "instruction", "output"
    )


def read_training_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    order: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A training table from CSV or JSON lines, all of it or its first rows.

    Files have no row order in Spark, so a limit needs ``order`` columns that say which rows come first.
    """
    if fmt == "csv":
        df = read_csv(spark, path, schema, missing_to_null=False)
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if limit is None:
        return df
    if not order:
        raise ValueError("a limit needs order columns")
    return df.orderBy(*order).limit(limit)


def folder_after(base_path: str, path: Column | str = "_metadata.file_path") -> Column:
    """Name of the folder below ``base_path`` in the path of the file a row came from."""
    path = F.col(path) if isinstance(path, str) else path
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(F.substring_index(decoded, f"/{base_path.strip('/')}/", -1), "/", 1)


def read_results(
    spark: SparkSession,
    root: str,
    task: LabelTask,
    models: Mapping[str, str],
    schema: T.StructType,
    text_col: str | None = "text",
    extra: Sequence[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """The result files of one dataset under every model folder, as long predictions.

    ``root/base_path/<model folder>/<file>`` may be a file or a folder of part files; whatever exists is read in
    one scan and the model comes from the folder name (see :func:`missing_results` for the rest). Ids increase
    along each file, so that later rows of a file have larger ids. ``extra`` names text columns that follow the
    prediction in the file, such as the ``cleaned_prediction`` and ``sentiment_label`` of a corrections file.
    """
    full = T.StructType(with_prediction(schema).fields + [T.StructField(c, T.StringType()) for c in extra])
    place = f"{root.rstrip('/')}/{task.base_path}/*/{task.file}"
    reader = spark.read.schema(full).option("header", True).option("escape", '"').option("enforceSchema", False)
    try:
        if multi_line:
            df = read_quoted_csv(spark, [place], full)
        else:
            df = reader.csv(place).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
        folder = folder_after(task.base_path, "_file")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df, folder = spark.createDataFrame([], full).withColumn("_row", F.lit(0).cast("long")), F.lit(None).cast("string")
    model = F
    for key, name in models.items():
        model = model.when(folder == name, key)
    rows = df.select(
        F.lit(task.name).alias("dataset"),
        model.alias("model"),
        F.col("_row").alias("row_id"),
        (F.col(text_col) if text_col else F.lit(None).cast("string")).alias("text"),
        null_tokens_to_null(task.label_col).alias("gold"),
        null_tokens_to_null(task.pred_col).alias("prediction"),
        *[null_tokens_to_null(c).alias(c) for c in extra],
    )
    return rows.filter("model is not null")


def missing_results(found: DataFrame, tasks: Sequence[LabelTask], models: Sequence[str]) -> DataFrame:
    """(dataset, model) pairs of the expected grid that ``found`` has no row of; see also :func:`read_result_tree`."""
    spark = found.sparkSession
    grid = spark.createDataFrame([(t.name, m) for t in tasks for m in models], "dataset string, model string")
    return grid.join(found.select("dataset", "model").distinct(), ["dataset", "model"], "left_anti")


@dataclass(frozen=True)
class ResultTree:
    """Rows (dataset, model, row_id, text, gold, prediction), pairs without a file, and files that could not be read."""

    rows: DataFrame
    missing: list[tuple[str, str]]
    skipped: list[tuple[str, str]]


def _cells(header: str) -> list[str]:
    """Names in a CSV header line."""
    return [name.strip() for name in next(csv.reader([header]), [])]


def read_result_tree(
    spark: SparkSession, root: str, tasks: Sequence[LabelTask], models: Mapping[str, str], text_col: str = "text",
    multi_line: bool = True,
) -> ResultTree:
    """The result files of all datasets and models, each under its own header.

    What exists comes from one listing. Files are grouped by header and each group is one scan. A file whose header
    lacks the label or the prediction of its dataset is split at bare commas if that finds them, and is otherwise
    skipped and reported, without touching other files. A file with only a header has no rows and is not missing.
    """
    base = root.rstrip("/")
    folders = {name: key for key, name in models.items()}
    globs = {task.name: f"{base}/{task.base_path.strip('/')}/*/{task.file}" for task in tasks}
    headers: dict[str, str] = {}
    for pattern in dict.fromkeys(globs.values()):
        try:
            headers |= lines.file_headers(spark, pattern)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    present, skipped = set(), []
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for file, header in sorted(headers.items()):
        parts = unquote(file).split("/")
        for task in tasks:
            inside = f"/{task.base_path.strip('/')}/"
            if inside not in unquote(file) or not fnmatch(parts[-1], task.file.split("/")[-1]):
                continue
            model = folders.get(unquote(file).split(inside, 1)[1].split("/", 1)[0])
            if model is None:
                continue
            present.add((task.name, model))
            needed = {task.label_col, task.pred_col}
            if needed <= set(_cells(header)):
                groups.setdefault((task.name, header, False), []).append(file)
            elif needed <= set(header.strip('"').split(",")):
                groups.setdefault((task.name, header, True), []).append(file)
            else:
                skipped.append((file, f"no column {sorted(needed - set(_cells(header)))}"))
    found = []
    by_name = {task.name: task for task in tasks}
    for (name, header, bare), files in groups.items():
        task = by_name[name]
        if bare:
            body = lines.body_lines(spark, files).withColumn("_file", F.col("_metadata.file_path"))
            if header.startswith('"'):  # whole lines in quotes
                body = body.withColumn("value", F.btrim("value", F.lit('"')))
            df, _ = lines.split_bare_csv(body, header.strip('"'), ["_file"])
            df = df.withColumn("_row", F.monotonically_increasing_id())
        else:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in _cells(header)])
            if multi_line:
                df = read_quoted_csv(spark, files, schema, check_header=False)
            else:
                df = read_csv(spark, files, schema, False, missing_to_null=False, check_header=False)
                df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())
        folder = folder_after(task.base_path, "_file")
        model = F
        for folder_name, key in folders.items():
            model = model.when(folder == folder_name, key)
        found.append(df.select(
            F.lit(task.name).alias("dataset"), model.alias("model"), F.col("_row").alias("row_id"),
            (F.col(text_col) if text_col in df.columns else F.lit(None).cast("string")).alias("text"),
            null_tokens_to_null(task.label_col).alias("gold"), null_tokens_to_null(task.pred_col).alias("prediction"),
        ))
    empty = "dataset string, model string, row_id long, text string, gold string, prediction string"
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)
    missing = [(t.name, m) for t in tasks for m in models if (t.name, m) not in present]
    return ResultTree(rows, missing, skipped)
