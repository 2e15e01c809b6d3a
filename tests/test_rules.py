"""Rules over written-out rows: what each operator has to give for edge values that the tables do not hold."""

import duckdb
import pytest

import rule_cases
import rule_checks
import rule_sources

RULES = rule_cases.QUERIES | rule_checks.QUERIES | rule_sources.QUERIES


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(spark, sf, name):
    query, sql = RULES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    r = duckdb.connect().execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())
