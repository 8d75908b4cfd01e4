import decimal
import random
from itertools import combinations

from pyspark.sql import functions as F

import pytest

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.operators import subsets
from ledgerloom.operators.reconcile import Policy, Run, Subset, Tier, read_columns
from ledgerloom.plans.scratch import by_real_sizes
from ledgerloom.queries import reconciling
from ledgerloom.relation import Relation


def side(spark, rows, schema, name):
    return Relation(spark.createDataFrame(rows, schema), name, ("id",))


def pairs(run):
    return sorted((r.a_id, r.b_id) for r in run.matches.collect())


def status(run, s):
    return {r["_id"]["id"]: r.status for r in run.status[s].collect()}


def test_mutual_best_rounds(spark):
    a = side(spark, [(1, 10), (2, 12), (3, 30)], "id long, amt long", "a")
    b = side(spark, [(1, 11), (2, 13), (3, 90)], "id long, amt long", "b")
    gap = F.abs(F.col("a.amt") - F.col("b.amt"))
    run = Run(a, b, Policy((Tier("near", require=(gap <= 5,), rank=((gap, False), (F.col("b.amt"), True)), block=()),))).run()
    assert pairs(run) == [(1, 1), (2, 2)]
    assert status(run, "a")[3] == "unmatched" and status(run, "b")[3] == "unmatched"


def test_interchangeable_rows_pair_in_identity_order(spark):
    a = side(spark, [(1, "k", 5), (2, "k", 5)], "id long, k string, amt long", "a")
    b = side(spark, [(7, "k", 5), (8, "k", 5)], "id long, k string, amt long", "b")
    run = Run(a, b, Policy((Tier("t", require=(F.col("a.amt") == F.col("b.amt"),)),), block=(("k", "k"),))).run()
    assert pairs(run) == [(1, 7), (2, 8)]


def test_leftover_copies_are_duplicates_and_others_ambiguous(spark):
    pol = Policy((Tier("t", require=(F.col("a.amt") == F.col("b.amt"),)),), block=(("k", "k"),))
    a = side(spark, [(1, "k", 5)], "id long, k string, amt long", "a")
    same = side(spark, [(7, "k", 5, "x"), (8, "k", 5, "x")], "id long, k string, amt long, note string", "b")
    run = Run(a, same, pol).run()
    assert pairs(run) == [(1, 7)] and status(run, "b") == {7: "matched", 8: "duplicate"}
    assert [(r.id, r.duplicate_of) for r in run.unmatched_b.collect()] == [(8, "7")]
    other = side(spark, [(7, "k", 5, "x"), (8, "k", 5, "y")], "id long, k string, amt long, note string", "b")
    run = Run(a, other, pol).run()
    assert pairs(run) == [] and status(run, "a") == {1: "ambiguous"} and run.ambiguous.count() == 2


def test_star(spark):
    a = side(spark, [(1, 5), (2, 5)], "id long, amt long", "a")
    b = side(spark, [(7, 5, "x"), (8, 5, "y")], "id long, amt long, cust string", "b")
    tier = Tier("t", require=(F.col("a.amt") == F.col("b.amt"), F.col("b.cust").isNotNull()), block=())
    assert pairs(Run(a, b, Policy((tier,))).run()) == [(1, 7), (2, 8)]
    lone = side(spark, [(1, 5)], "id long, amt long", "a")
    run = Run(lone, b, Policy((tier,))).run()
    assert pairs(run) == [] and set(status(run, "b").values()) == {"ambiguous"}


def test_tiers_consume_and_null_keys(spark):
    a = side(spark, [(1, "x", 5), (2, None, 5), (3, "y", 6)], "id long, k string, amt long", "a")
    b = side(spark, [(1, "x", 5), (2, None, 5), (3, "z", 6)], "id long, k string, amt long", "b")
    amt = F.col("a.amt") == F.col("b.amt")
    tiers = (Tier("key", require=(amt,), block=(("k", "k"),)), Tier("amount", require=(amt,), block=()))
    run = Run(a, b, Policy(tiers)).run()
    assert pairs(run) == [(1, 1), (2, 2), (3, 3)]
    assert {(r.step, r.pairs) for r in run.summary.collect()} >= {("key", 1), ("amount", 2), ("total", 3)}
    assert sum(r.a_rows for r in run.summary.collect() if r.step in ("key", "amount", "unmatched", "ambiguous", "duplicate")) == 3
    with pytest.raises(RunError):
        Run(side(spark, [(1, 1), (1, 2)], "id long, amt long", "a"), side(spark, [(1, 1)], "id long, amt long", "b"), Policy(tiers))


def test_many_to_one_prefers_copies_in_order(spark):
    a = side(spark, [(1, 5), (2, 5), (3, 7)], "id long, amt long", "a")
    b = side(spark, [(7, 5, "x"), (8, 5, "x"), (9, 7, "p"), (10, 7, "q")], "id long, amt long, note string", "b")
    run = Run(a, b, Policy((Tier("t", require=(F.col("a.amt") == F.col("b.amt"),), block=()),), cardinality="many_to_one")).run()
    assert pairs(run) == [(1, 7), (2, 7)]
    assert status(run, "b")[8] == "duplicate" and status(run, "a")[3] == "ambiguous"


def test_rollup(spark):
    a = side(spark, [(1, "o", 2), (2, "o", 3), (3, "p", 4), (4, None, 5)], "id long, org string, kg long", "a")
    b = side(spark, [(7, "o", 5), (8, "p", 9)], "id long, org string, kg long", "b")
    tier = Tier("r", group_a=("org",), lift_a={"kg": F.sum("kg")}, block=(("org", "org"),), require=(F.col("a.kg") == F.col("b.kg"),))
    run = Run(a, b, Policy((tier,))).run()
    assert pairs(run) == [(1, 7), (2, 7)] and status(run, "a")[4] == "unmatched"


def test_subset_search():
    found, examined = subsets.search([100, 100, 200, 300], [0, 0, 1, 2], 300, 3, 100)
    assert sorted(found) == [(0, 2), (3,)] and examined <= 15
    assert subsets.upfront(5, 2) == 15
    with pytest.raises(RunError):
        subsets.search(list(range(1, 20)), list(range(19)), 60, 6, 20)


def test_subset_sums_are_exact(spark):
    """No two of these add up to the target at the columns' own scale, though they do when rounded to four places."""
    schema = "id long, amount decimal(18,6)"
    D = decimal.Decimal
    a = side(spark, [(1, D("1.000001")), (2, D("0.900000"))], schema, "a")
    b = side(spark, [(11, D("0.400000")), (12, D("0.600049")), (13, D("0.500000"))], schema, "b")
    policy = Policy((Tier("payout", block=(), subset=Subset("b", "amount", "amount", max_items=2)),))
    assert pairs(Run(a, b, policy).run()) == [(2, 11), (2, 13)]
    floats = Relation(b.df.withColumn("amount", F.col("amount").cast("double")), "b", ("id",))
    with pytest.raises(AnalysisError, match="L314"):
        Run(a, floats, policy).run()


def test_subset_budget_is_the_tiers(spark):
    """Each unit examines fewer subsets than the budget, both together more."""
    a = side(spark, [(1, "x", 3), (2, "y", 3)], "id long, k string, amount long", "a")
    b = side(spark, [(i, k, i) for k, base in (("x", 0), ("y", 10)) for i in range(base + 1, base + 4)], "id long, k string, amount long", "b")
    tier = lambda n: Tier("payout", block=(("k", "k"),), subset=Subset("b", "amount", "amount", max_items=2, max_subsets=n))
    run = Run(a, b, Policy((tier(1000),))).run()
    cost = run.costs["payout"]
    assert (cost["units"], cost["largest"], cost["bound"]) == (2, 3, 12) and 0 < cost["examined"] <= 12
    with pytest.raises(RunError, match="L315"):
        Run(a, b, Policy((tier(cost["examined"] - 1),))).run()


def test_a_task_stops_beyond_the_budget(spark):
    """The error is the run's own, and tells of the tier, also where a single unit has too many subsets."""
    a = side(spark, [(1, 60)], "id long, amount long", "a")
    b = side(spark, [(i, i) for i in range(1, 20)], "id long, amount long", "b")
    tier = Tier("payout", block=(), subset=Subset("b", "amount", "amount", max_items=6, max_subsets=20))
    with pytest.raises(RunError, match="L315.*payout"):
        Run(a, b, Policy((tier,))).run()


def test_policy_columns_come_from_the_tree(spark):
    """A column with a blank in its name tells rows apart; a text that looks like a column doesn't."""
    a = side(spark, [(1, "p", 5), (2, "q", 5)], "id long, `order id` string, amt long", "a")
    b = side(spark, [(7, "q", 5), (8, "p", 5)], "id long, `order id` string, amt long", "b")
    same = F.col("a.`order id`") == F.col("b.`order id`")
    assert pairs(Run(a, b, Policy((Tier("t", require=(same,), block=()),))).run()) == [(1, 8), (2, 7)]
    assert read_columns([same, F.lit("a.amt") == F.col("b.amt"), F.expr("a.x + b.y > 1")], "a") == {"order id", "x"}


def test_outputs_have_their_columns_without_rows(spark):
    a = side(spark, [(1, 5)], "id long, amt long", "a")
    b = side(spark, [(7, 6)], "id long, amt long", "b")
    tier = Tier("t", require=(F.col("a.amt") == F.col("b.amt"),), block=(), evidence={"gap": F.col("b.amt") - F.col("a.amt")}, flags={"big": F.col("a.amt") > 3})
    run = Run(a, b, Policy((tier,)), ("bank", "book")).run()
    head = ["tier", "tier_index", "a_group", "b_group", "bank_id", "book_id"]
    assert run.matches.columns == [*head, "gap", "big", "flags", "candidates_a", "candidates_b", "candidate_rank", "rank_values", "reason", "bank_amt", "book_amt"]
    assert run.ambiguous.columns[:3] == ["tier", "tier_index", "ambiguity_id"] and run.candidates.columns[:7] == [*head, "outcome"]
    assert all(x.isEmpty() for x in (run.matches, run.ambiguous, run.candidates))
    near = Run(a, b, Policy((Tier("t", require=(F.col("a.amt") <= F.col("b.amt"),), block=(), evidence=tier.evidence, flags=tier.flags),)), ("bank", "book")).run().matches.first()
    assert (near.gap, near.big, near.flags, near.bank_id, near.book_amt) == (1, True, "big", 1, 6) and "a.amt" in near.reason.replace("'", "")


def test_rows_without_identity_are_numbered_by_content(spark):
    make = lambda rows, name: Relation(spark.createDataFrame(rows, "k string, amt long").repartition(3), name)
    a, b = make([("b", 2), ("a", 2), ("a", 1), ("a", 1)], "a"), make([("a", 1)], "b")
    run = Run(a, b, Policy((Tier("t", block=(("k", "k"), ("amt", "amt"))),))).run()
    assert [(r.a_row, r.k, r.amt, r.match_status) for r in run.unmatched_a.orderBy("a_row").collect()] == [(2, "a", 1, "duplicate"), (3, "a", 2, "unmatched"), (4, "b", 2, "unmatched")]
    assert run.matches.first().a_row == 1


def test_ambiguities_are_numbered_in_order(spark):
    a = side(spark, [(i, i) for i in range(1, 6)], "id long, k long", "a")
    b = side(spark, [(10 * i + j, i, str(j)) for i in range(1, 6) for j in (1, 2)], "id long, k long, note string", "b")
    got = Run(a, b, Policy((Tier("t", block=(("k", "k"),)),))).run().ambiguous.collect()
    assert sorted({r.ambiguity_id for r in got}) == [1, 2, 3, 4, 5] and all(r.a_k == r.b_k for r in got) and len(got) == 10


def matched_by_hand(a, b, gap, most):
    """Mutual best pairs, round by round, of rows that all differ; what ties is left."""
    a, b, out = dict(a), dict(b), []
    cand = {(i, j): gap(a[i], b[j]) for i in a for j in b if gap(a[i], b[j]) is not None and gap(a[i], b[j]) <= most}
    while True:
        best_a = {i: [j for (x, j), g in cand.items() if x == i and g == min(h for (y, _), h in cand.items() if y == i)] for i in {i for i, _ in cand}}
        best_b = {j: [i for (i, y), g in cand.items() if y == j and g == min(h for (_, z), h in cand.items() if z == j)] for j in {j for _, j in cand}}
        found = [(i, js[0]) for i, js in best_a.items() if len(js) == 1 and best_b[js[0]] == [i]]
        if not found:
            return sorted(out)
        out += found
        gone_a, gone_b = {i for i, _ in found}, {j for _, j in found}
        cand = {(i, j): g for (i, j), g in cand.items() if i not in gone_a and j not in gone_b}


def test_rounds_match_brute_force(spark):
    rnd = random.Random(4)
    spread = rnd.sample(range(400), 60)  # all differ; no two distances of a row are equal, or the case is drawn again
    a, b = {i: 2 * x for i, x in enumerate(spread[:30])}, {100 + i: 2 * x + rnd.choice([0, 1]) for i, x in enumerate(spread[30:])}
    near = F.abs(F.col("a.v") - F.col("b.v"))
    run = Run(side(spark, list(a.items()), "id long, v long", "a"), side(spark, list(b.items()), "id long, v long", "b"), Policy((Tier("t", require=(near <= 40,), rank=((near, False),), block=()),))).run()
    want = matched_by_hand(a, b, lambda x, y: abs(x - y), 40)
    assert len(want) > 12 and set(want) <= set(pairs(run)) and run.rounds["t"] > 1
    tied = {r.a_id for r in run.ambiguous.collect()} | {r.b_id for r in run.ambiguous.collect()}
    assert all(not {i, j} & tied for i, j in want)


def test_subset_tier(spark):
    a = side(spark, [(1, 300), (2, 100), (3, 999)], "id long, amount long", "a")
    b = side(spark, [(11, 100), (12, 200), (13, 100)], "id long, amount long", "b")
    tier = Tier("payout", block=(), subset=Subset("b", "amount", "amount", max_items=2))
    run = Run(a, b, Policy((tier,))).run()
    got = pairs(run)
    assert {x for x, _ in got} == {1, 2} and len({y for _, y in got}) == 3  # the copies of 100 are shared out
    with pytest.raises(AnalysisError):
        Run(a, b, Policy((Tier("x", subset=Subset("b", "amount", "amount", max_items=17)),)))


def test_subset_query_matches_brute_force(spark, tmp_path):
    """Orders whose payout is a combination of four and more lines, up to a dozen."""
    orders = {1: [1, 2, 4, 8, -16, -32], 2: [1, 2, 3], 3: [10, 20, 30, 40, -60], 4: [2**i for i in range(9)] + [-512], 5: [2**i for i in range(12)], 6: [5, -7], 7: [-7]}  # lines that are not paid: below 0
    lines = [(o, 1 + i % 2 if q > 0 else 3, abs(q)) for o, qs in orders.items() for i, q in enumerate(qs)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = []
    for o in orders:
        own = [(n, q) for k, n, q in lines if k == o]
        paid = sum(q for n, q in own if n <= 2)
        fit = [c for k in range(1, len(own) + 1) for c in combinations(own, k) if sum(q for _, q in c) == paid]
        best = [c for c in fit if len(c) == len(fit[0])] if fit else []
        if len(best) == 1:
            want += [(o, paid, n, q, len(fit)) for n, q in best[0]]
    assert {sum(w[0] == o for w in want) for o in (1, 4, 5)} == {4, 9, 12}
    assert sorted(map(tuple, reconciling.reconcile_subset_sum(spark, str(tmp_path)).collect())) == sorted(want)


def test_no_table_is_broadcast_by_its_planned_size(spark, tmp_path):
    """Files of scratch tables are small, their rows need not be: the driver gathers none of them."""
    spark.range(300).selectExpr("id", "id % 300 as k").write.parquet(f"{tmp_path}/t")
    make = lambda name: Relation(spark.read.parquet(f"{tmp_path}/t"), name, ("id",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    run = Run(make("a"), make("b"), Policy((Tier("t", block=(("k", "k"),)),))).run()
    for df in (run.matches, run.unmatched_a, run.candidates):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(pairs(run)) == 300 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    with by_real_sizes(spark):
        a, b = (make(x).df for x in "ab")
        plan = a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
