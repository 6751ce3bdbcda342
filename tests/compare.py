"""Run a registered query and its SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted(names), _rows(names, rel.fetchall())


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def schema_difference(df, con, sql) -> str | None:
    """None when columns, their order and their types agree."""
    rel = con.sql(sql)
    got = [(n, TYPES.get(t, t)) for n, t in df.dtypes]
    want = list(zip(rel.columns, map(str, rel.types)))
    return None if got == want else f"{got} != {want}"


def difference(df, con, sql) -> str | None:
    """None when equal, else the first rows that differ."""
    got_names, got = spark_rows(df)
    want_names, want = sql_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got == want:
        return None
    got_set, want_set = {repr(r) for r in got}, {repr(r) for r in want}
    only_got = [r[:400] for r in sorted(got_set - want_set)[:3]]
    only_want = [r[:400] for r in sorted(want_set - got_set)[:3]]
    return f"{len(got)} rows vs {len(want)}; {len(got_set - want_set)} only in Spark {only_got}; only in SQL {only_want}"
