"""Compare a query with its SQL, order aside."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def sql_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def assert_same(df, folder: str, sql: str) -> int:
    a, b = spark_rows(df), sql_rows(folder, sql)
    assert a[0] == b[0], (a[0], b[0])
    missing, extra = b[1] - a[1], a[1] - b[1]
    assert not missing and not extra, (len(missing), len(extra), list(missing)[:2], list(extra)[:2])
    return sum(a[1].values())
