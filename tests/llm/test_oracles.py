"""The operators' queries agree with their SQL on the smallest tables."""

import os

import duckdb
import pytest

from docloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_agrees_with_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = db.execute(oracles.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == columns
    theirs = sorted((tuple(r[order.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == theirs
