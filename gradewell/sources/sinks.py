"""Writers (S10 to S15). Every writer goes to a path of its own and refuses to replace what it reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from gradewell.plans.skew import number_rows


# Folder of a versioned table whose files, named by number, say where each version lies.
_MANIFESTS = "versions"


def _file_system(spark: SparkSession, name: str):
    """The file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _csv_writer(df: DataFrame) -> DataFrameWriter:
    """Header, doubled quotes, and blanks kept as they are."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return df.write.options(header=True, escape='"', **keep)


def write_csv(df: DataFrame, path: str, bom: bool = False, partition_by: Sequence[str] = ()) -> None:
    """CSV with header and doubled quotes, optionally with a byte-order mark at the head of each file."""
    if bom:
        first = [c for c in df.columns if c not in partition_by][0]
        df = df.withColumnRenamed(first, "﻿" + first)
    _csv_writer(df).partitionBy(*partition_by).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """S10 as Parquet, one folder per task, dataset and model, so that jobs over some of them read only those."""
    df.write.partitionBy("task", "dataset", "model").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, non-ASCII text kept, null fields kept."""
    df.write.option("ignoreNullFields", False).json(path)


def write_json_arrays(
    df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str], rows_per_file: int = 10_000,
    bytes_per_file: int = 64 << 20,
) -> None:
    """JSON array files of ``fields``, in the order of ``order`` and with at most ``rows_per_file`` records each.

    With long records there are fewer, so that a file stays below ``bytes_per_file`` (a single longer record has a
    file of its own). Rows are numbered over the whole table first, so no file grows with a popular key.
    """
    numbered = number_rows(df, order, "_n")
    as_text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    longest = numbered.agg(F.max(F.octet_length(as_text))).first()[0] or 1
    per_file = max(1, min(rows_per_file, bytes_per_file // longest))
    record = F.struct("_n", as_text.alias("record"))
    arrays = numbered.groupBy(F.expr(f"_n div {per_file}")).agg(F.sort_array(F.collect_list(record)).alias("records"))
    text = F.concat(F.lit("["), F.array_join(F.transform("records", lambda r: r["record"]), ","), F.lit("]"))
    arrays.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def report_text(metrics: DataFrame, by: Sequence[str], columns: Mapping[str, int | None]) -> DataFrame:
    """One text block per row of a metric table; ``columns`` gives the places each metric is rounded to.

    A missing or undefined value reads ``nan``.
    """
    values = {c: F.col(c) for c in by}
    values |= {c: F.col(c) if places is None else F.round(c, places) for c, places in columns.items()}
    lines = []
    for name, value in values.items():
        text = value.cast("string")
        shown = F.when(text.isNull() | (text == "NaN"), "nan").otherwise(text)
        lines.append(F.concat(F.lit(f"{name}: "), shown))
    return metrics.select(*by, F.concat_ws("\n", *lines, F.lit("-" * 40)).alias("value"))


def write_report(metrics: DataFrame, path: str, by: Sequence[str], columns: Mapping[str, int | None]) -> None:
    """S12 to files, in order of the group columns (a metric table has one row per model and dataset)."""
    report_text(metrics, by, columns).orderBy(*by).select("value").write.text(path)


def write_by_dataset(df: DataFrame, path: str) -> None:
    """One folder per dataset."""
    _csv_writer(df).partitionBy("dataset").csv(path)


def rewrite_table(
    spark: SparkSession, source: str, target: str, change: Callable[[DataFrame], DataFrame], fmt: str = "parquet"
) -> DataFrame:
    """Read a table, change it and write it as a new version; the version read stays untouched."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write the new version to another path than the one read")
    change(spark.read.format(fmt).load(source)).write.format(fmt).save(target)
    return spark.read.format(fmt).load(target)


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the newest complete version of a versioned table; 0 if there is none."""
    system, path = _file_system(spark, f"{root}/{_MANIFESTS}")
    if not system.exists(path):
        return 0
    names = [entry.getPath().getName() for entry in system.listStatus(path)]
    return max((int(name) for name in names if name.isdigit()), default=0)


def read_version(spark: SparkSession, root: str, version: int | None = None, fmt: str = "parquet") -> DataFrame:
    """The current version of a versioned table, or the one asked for."""
    version = current_version(spark, root) if version is None else version
    system, manifest = _file_system(spark, f"{root}/{_MANIFESTS}/{version}")
    if not system.exists(manifest):
        raise FileNotFoundError(f"{root} has no version {version}")
    folder = spark.read.text(manifest.toString()).first()[0]
    return spark.read.format(fmt).load(f"{root}/{folder}")


def write_version(df: DataFrame, root: str, base: int, fmt: str = "parquet") -> int:
    """Write ``df`` as the version after ``base``, visible to readers all at once.

    The rows go to a folder of their own. Then a manifest that names the folder is renamed into place, which is one step
    of the file system and fails if another writer has already put a version there. Until then, and for ever
    if the write fails, readers see version ``base``.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{folder}")
    system, manifests = _file_system(spark, f"{root}/{_MANIFESTS}")
    system.mkdirs(manifests)
    _, draft = _file_system(spark, f"{root}/{_MANIFESTS}/.{folder}")
    out = system.create(draft, False)
    out.write(folder.encode())
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    options = gateway.new_array(getattr(fs, "Options$Rename"), 0)
    files = fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    target = fs.Path(f"{root}/{_MANIFESTS}/{base + 1}")
    try:
        files.rename(draft, target, options)
    except Py4JJavaError as error:
        if system.exists(target):
            raise FileExistsError(f"version {base + 1} of {root} was written by another job") from error
        raise
    return base + 1


def change_table(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> DataFrame:
    """S14 in place: read the current version, change it, and make the result current; a failing change alters nothing."""
    base = current_version(spark, root)
    written = write_version(change(read_version(spark, root, base, fmt)), root, base, fmt)
    return read_version(spark, root, written, fmt)


def write_invalid(df: DataFrame, path: str) -> None:
    """Invalid rows by dataset and model; a pair without such rows gets no folder."""
    write_csv(df, path, partition_by=("dataset", "model"))
