"""Every registered job against its SQL in DuckDB, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from marketlens import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = jobs.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    result = duck.execute(jobs.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in place) for r in result.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(jobs.QUERIES) - set(jobs.ORACLE_SQL) - {"ml_forecast"}))
def test_runs(spark, name):
    assert jobs.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_entry_lives_without_the_text_operators_libraries():
    """A library that only the text operators need may be missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0 and int(done.stdout.split()[0]) == len(jobs.QUERIES), done.stderr
