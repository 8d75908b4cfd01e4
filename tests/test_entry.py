"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
import os

import pytest

import __spark_entry__
from ledgerloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else str(int(v)) if isinstance(v, bool) else str(v)


def rows(columns, data):
    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(columns, [r.asDict() for r in df.collect()])
    if name in catalog.oracle_sql():
        cur = con.execute(catalog.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        assert got == rows(columns, [dict(zip(names, r)) for r in cur.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["a_o_orderkey", "b_entry", "tier"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_joins_over_whole_tables(spark, con):
    """Every row of the tables is met; the queries' rows are compared with their SQL above."""
    q, keys = catalog.queries(), lambda sql: {r[0] for r in con.execute(sql).fetchall()}
    orders, events = keys("select o_orderkey from orders"), keys("select event_id from events")
    for how in ("left", "right", "full"):
        got = q[f"join_{how}_whole"](spark, SF).collect()
        assert {r.o_orderkey for r in got} - {None} == orders
        assert how == "right" or {r.cust for r in got} >= keys("select c_custkey from customer")
    semi, anti = ({r.o_orderkey for r in q[f"join_{k}_whole"](spark, SF).collect()} for k in ("semi", "anti"))
    assert semi and anti and not semi & anti and semi | anti == orders
    assert {r.event_id for r in q["asof_join_whole"](spark, SF).collect()} == {r.event_id for r in q["asof_left_join_whole"](spark, SF).collect()} == events
