"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
OWN = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, name):
    df = OWN[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
