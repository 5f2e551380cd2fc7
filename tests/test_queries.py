"""Each query of the engine against its SQL, and plans that push filters to the scan."""

import os

import duckdb
import pytest
from kinledger import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, db, name):
    df = q.queries()[name](spark, SF)
    con = db.execute(q.oracle_sql()[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in con.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_filters_reach_the_scan(spark):
    plan = q.q_query_objects_owner(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "EqualTo(o_custkey,10)" in plan and "o_orderkey" in plan and "lineitem" not in plan
    assert "WindowGroupLimit" in q.q_top3_per_owner(spark, SF)._jdf.queryExecution().executedPlan().toString()
