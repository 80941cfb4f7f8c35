"""Every registered query equals its brute-force SQL twin (DuckDB) at sf0.001."""

import math

import duckdb
import pytest

from equiclass.plans.catalog import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (1, "nan")
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf001, name):
    df = QUERIES[name](spark, sf001)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert cols == sorted(names)
    assert len(got) == len(want)
    assert got == want
