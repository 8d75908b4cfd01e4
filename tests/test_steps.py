import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.operators import steps as P
from ledgerloom.operators import validate as V
from ledgerloom.plans import compare
from ledgerloom.relation import Relation


def rel(spark, rows, schema, name="t", identity=()):
    return Relation(spark.createDataFrame(rows, schema), name=name, identity=identity)


def test_steps_track_identity_and_order(spark):
    r = rel(spark, [(1, "b"), (2, "a"), (3, None)], "id long, x string", identity=("id",))
    s = P.sort(r, "-x")
    assert [x.id for x in P.limit(s, 3).df.collect()] == [1, 2, 3]  # nulls last in descending order too
    assert P.rename(s, id="key").identity == ("key",)
    assert P.select(r, "x").identity == () and P.select(s, "id").sort == ()
    assert P.derive(r, x=F.upper("x"), y=F.col("x")).df.filter("id = 1").first().y == "B"
    for bad in (lambda: P.limit(r, 1), lambda: P.drop(r, "id", "x"), lambda: P.select(r, "nope"), lambda: P.select(r, "id", "ID")):
        with pytest.raises(AnalysisError):
            bad()


def test_names_after_joins(spark):
    a = rel(spark, [(1, "x"), (2, "y")], "id long, v string", "a")
    b = rel(spark, [(2, "p"), (3, "q")], "ID long, v string", "b")
    j = P.join(a, b, ("id",), "full")
    assert j.columns == ["id", "a_v", "b_v"]
    assert sorted(map(tuple, j.df.collect())) == [(1, "x", None), (2, "y", "p"), (3, None, "q")]
    with pytest.raises(AnalysisError):
        P.join(a, a, ("id",))
    assert P.join(a, a, ("id",), alias="o").df.count() == 2


def test_null_keys_never_match(spark):
    a = rel(spark, [(None, 1), (1, 2)], "k long, x long", "a")
    b = rel(spark, [(None, 3), (1, 4)], "k long, y long", "b")
    assert [tuple(r) for r in P.join(a, b, ("k",)).df.collect()] == [(1, 2, 4)]
    assert [tuple(r) for r in P.filter_(a, F.col("k") != 1).df.collect()] == []


def test_union_and_normalize(spark):
    a, b = rel(spark, [(1, "x")], "k int, n string", "a"), rel(spark, [("y", 2)], "N string, K long", "b")
    assert sorted(map(tuple, P.union(a, b).df.collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(AnalysisError):
        P.union(a, rel(spark, [(1,)], "k int"))
    n = P.normalize(a, "n", {("x", "z"): "letter"})
    assert n.df.first().n == "letter"
    with pytest.raises(AnalysisError):
        P.normalize(a, "n", {"x": 1, ("x", "y"): 2})


def test_window_total_order(spark):
    r = rel(spark, [("a", 80, 1), ("b", 80, 2), ("c", 90, 3), ("d", None, 4)], "name string, score int, amount long")
    w = P.window(r, (), ("-score",), n=("row_number",), r=("rank",), d=("dense_rank",), p=("lag", "amount"), s=("running_sum", "amount"), t=("sum", "amount"))
    got = {x["name"]: (x.n, x.r, x.d, x.p, x.s, x.t) for x in w.df.collect()}
    assert got == {"c": (1, 1, 1, None, 3, 10), "a": (2, 2, 2, 3, 4, 10), "b": (3, 2, 2, 1, 6, 10), "d": (4, 4, 3, 2, 10, 10)}
    with pytest.raises(AnalysisError):
        P.window(r, (), (), n=("row_number",))
    with pytest.raises(AnalysisError):
        P.window(r, (), ("score",), n=("count_distinct", "name"))


def test_asof(spark):
    day = datetime.date
    rates = rel(spark, [("EUR", day(2024, 1, 1), 1), ("EUR", day(2024, 1, 5), 2), ("USD", None, 9)], "cur string, day date, rate int", "rates", ("cur", "day"))
    asks = rel(spark, [(1, "EUR", day(2024, 1, 5)), (2, "EUR", day(2023, 1, 1)), (3, "XXX", day(2024, 1, 5)), (4, "EUR", None), (5, "EUR", day(2024, 1, 4)), (6, None, day(2024, 1, 4))], "id int, cur string, day date", "asks", ("id",))
    run = lambda op, left: {r.id: r.rate for r in P.asof(asks, rates, (("cur", "cur"),), ("day", op, "day"), left).df.collect()}
    assert run(">=", False) == {1: 2, 5: 1}
    assert run(">", False) == {1: 1, 5: 1}
    assert run("<=", False) == {1: 2, 2: 1, 5: 2}
    assert run("<", False) == {2: 1, 5: 2}
    assert run(">=", True) == {1: 2, 2: None, 3: None, 4: None, 5: 1, 6: None}
    with pytest.raises(AnalysisError):
        P.asof(asks, Relation(rates.df, "rates"), (("cur", "cur"),), ("day", ">=", "day"))
    with pytest.raises(AnalysisError):
        P.asof(asks, rates, (("cur", "cur"),), ("day", "==", "day"))


def test_validation(spark):
    r = rel(spark, [(1, 5), (2, None), (2, -1), (None, 3), (None, 4)], "id long, amount long", "orders")
    checks = [V.row("positive", F.col("amount") >= 0), V.not_null("id", "expect"), V.unique("id", severity="warn"), V.whole("sum", F.sum("amount"), lambda m: m > 100, "warn")]
    got = {x.check: (x.status, x.failing_rows, x.total_rows, x.measured) for x in V.results(r, checks).collect()}
    assert got == {"positive": ("fail", 1, 5, None), "id not null": ("fail", 2, 5, None), "unique(id)": ("fail", 4, 5, None), "sum": ("fail", None, 5, "11")}
    assert V.failures(r, checks).groupBy("check").count().count() == 3
    with pytest.raises(RunError) as e:
        V.enforce(r, checks)
    assert e.value.code == "L402" and "-1" not in str(e.value)
    empty = r.with_(r.df.limit(0))
    assert {x.check: x.status for x in V.results(empty, checks).collect()}["sum"] == "fail"


def test_compare(spark, tmp_path):
    a = rel(spark, [(1, "x"), (1, "x"), (2, None)], "k int, v string", "a")
    b = rel(spark, [(1, "x"), (2, None), (3, "z")], "k int, v string", "a")
    assert sorted(tuple(r) for r in compare.diff(a, b).collect()) == [("added", "3", "z", 1), ("removed", "1", "x", 1)]
    assert compare.same(a, a) and not compare.same(a, b)
    p = {r["column"]: r for r in compare.profile(a).collect()}
    assert (p["k"]["sum"], p["v"]["nulls"], p["v"]["distinct_values"]) == ("4", 1, 1)
    compare.snapshot(spark, f"{tmp_path}/one", {"a": a}), compare.snapshot(spark, f"{tmp_path}/two", {"a": b, "c": b})
    d = compare.diff_snapshots(spark, f"{tmp_path}/one", f"{tmp_path}/two")
    assert d["c"] == {"only_in": "second"} and (d["a"]["added"], d["a"]["removed"]) == (1, 1)


def test_profile_counts_values_column_by_column(spark):
    """No row is there once for each column with all of them."""
    from ledgerloom.plans.compare import profile

    r = Relation(spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, None)], "`k 1` long, s string, e long"))
    got = profile(r)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x["column"], x.nulls, x.distinct_values, x["sum"]) for x in got.collect()] == [("k 1", 0, 2, "5"), ("s", 1, 1, None), ("e", 3, 0, None)]
    assert [(x.rows, x.distinct_values) for x in profile(r.with_(r.df.limit(0))).collect()] == [(0, 0)] * 3
