"""Comparison of a query's rows with DuckDB's, as multisets under sorted column names."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert len(got) == len(want)
    assert got == want
