"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def rows(columns: list[str], found: list[tuple]) -> list[str]:
    """Rows as text, columns by name, numbers in one form, in any order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    form = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted("|".join(form(r[i]) for i in order) for r in found)


def difference(df, con, sql: str) -> str:
    """Empty if the DataFrame and the SQL have the same columns and rows."""
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    right = rows(names, result.fetchall())
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return "" if left == right else f"{len(left)} and {len(right)} rows, {len(wrong)} differ: {wrong[:2]}"
