"""Runs a query's SQL in DuckDB over the same tables."""

import glob

import duckdb


def oracle(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def same(df, sql: str, sf: str) -> int:
    """Asserts equal rows, by column name; returns how many."""
    names, want = oracle(sql, sf)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
