"""Every registered query against its SQL, over the smallest tables."""

import glob
import subprocess
import sys

import duckdb
import pytest

from quillgraph.plans.oracles import ORACLES
from quillgraph.plans.queries import QUERIES

#: A table function has no form in SQL; its rows are checked in test_rules.
NO_SQL = {"derivative_table"}


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL and not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    out = con.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, out.fetchall()))


def test_entry_is_readable_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=False).returncode == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
