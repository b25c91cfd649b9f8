"""Run a registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return repr(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, sorted(tuple(_plain(v) for v in row) for row in rows)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    return [columns[i] for i in order], sorted(rows)


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    spark_names, left = spark_rows(df)
    sql_names, right = sql_rows(con, sql)
    if spark_names != sql_names:
        return f"columns {spark_names} / {sql_names}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; e.g. {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"spark {str(a)[:600]} / sql {str(b)[:600]}"
    return None
