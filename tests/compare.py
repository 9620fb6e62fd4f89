"""A query's rows beside the rows DuckDB gives for its SQL."""

from __future__ import annotations

import datetime
import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame

ROOT = Path(os.environ.get("TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needs_data(sf: str) -> str:
    """The folder of a scale, or skip the test."""
    folder = ROOT / sf
    if not folder.is_dir():
        pytest.skip(f"no {folder}")
    return str(folder)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = db.execute(sql)
        return [c[0] for c in found.description], found.fetchall()


def plain(x):
    """A value as both engines show it."""
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ")
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    lines = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(lines, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df: DataFrame, sf_dir: str, sql: str, near: float = 0.0) -> list[str]:
    """What is different, empty if nothing is; ``near`` allows floats that relative error."""
    columns, mine = table(df.columns, [tuple(r) for r in df.collect()])
    names, theirs = table(*sql_rows(sf_dir, sql))
    if columns != names:
        return [f"columns {columns} and {names}"]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"] + [str(r) for r in mine[:2]] + [str(r) for r in theirs[:2]]
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=near, abs_tol=near)
    return [f"{a} and {b}" for a, b in zip(mine, theirs) if not all(map(same, a, b))]
