"""Query results beside those of DuckDB on the same files."""

import glob
import math
from pathlib import Path

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    want = canonical([c[0] for c in found.description], found.fetchall())
    got = canonical(df.columns, df.collect())
    assert got[0] == want[0]
    for a, b in zip(got[1], want[1]):
        assert a == b
    assert len(got[1]) == len(want[1])
    return len(got[1])
