"""Subset tiers: one unit equals a combination of rows of the other side, within a stated bound.

Members are joined to their unit by block and conditions; each unit's members become one row, and a task's rows are searched one after
another, depth first over whole numbers at the columns' own scale. The budget of examined subsets is the tier's: a task that has examined
more by itself stops, and so does the run. A partial subset is extended only while the remaining items can still bring its sum to
the target. Copies (rows equal but for identity) are taken in identity order, so subsets that differ by copies count once.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import accumulate
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import AnalysisError, RunError


def search(values: list[int], copies: list[int], target: int, max_items: int, budget: int) -> tuple[list[tuple[int, ...]], int]:
    """Index tuples that sum to the target, and how many subsets were examined; values in any order, equal copy numbers side by side.

    Stops with more than ``budget`` examined.
    """
    n = len(values)
    positive = [sorted((v for v in values[i:] if v > 0), reverse=True) for i in range(n + 1)]
    negative = [sorted(v for v in values[i:] if v < 0) for i in range(n + 1)]
    high = [[0, *accumulate(p[:max_items])] for p in positive]
    low = [[0, *accumulate(p[:max_items])] for p in negative]
    found, examined = [], 0
    stack: list[tuple[tuple[int, ...], int, int]] = [((), 0, 0)]
    while stack:
        chosen, total, start = stack.pop()
        left = max_items - len(chosen)
        for i in range(start, n):
            # of several copies the first ones are taken
            if i > start and copies[i] == copies[i - 1]:
                continue
            examined += 1
            if examined > budget:
                raise RunError("L315", f"more than {budget} subsets; block or require more, or lower max_items")
            s, nxt = total + values[i], i + 1
            if s == target:
                found.append((*chosen, i))
            if left > 1 and nxt < n:
                up, down = high[nxt], low[nxt]
                if s + down[min(left - 1, len(down) - 1)] <= target <= s + up[min(left - 1, len(up) - 1)]:
                    stack.append(((*chosen, i), s, nxt))
    return found, examined


def upfront(members: int, max_items: int) -> int:
    """Subsets of a unit of so many rows: what a search without pruning would examine."""
    return sum(comb(members, k) for k in range(1, min(members, max_items) + 1))


def tier(run, index: int, t) -> None:
    """Run a subset tier: ``run`` is the reconciliation."""
    spec = t.subset
    s, o = spec.side, "b" if spec.side == "a" else "a"
    units, grouped = run._units(t, o)
    rows = run._available(s).withColumn("_unit", F.col("_id"))
    cand = run.scratch.keep(_members(run, t, units, rows, s, o))
    scale = 0
    for c in ("_amount", "_target"):
        kind = cand.schema[c].dataType
        if not isinstance(kind, (T.IntegralType, T.DecimalType)):
            raise AnalysisError("L314", f"a subset adds up whole numbers or decimals, not {kind.simpleString()}")
        scale = max(scale, getattr(kind, "scale", 0))
    ready = cand.select(f"u{o}", f"u{s}", F.col("_amount").cast("string").alias("v"), F.col("_target").cast("string").alias("t"), F.to_json(f"x{s}").alias("x"), F.to_json(f"u{o}").alias("unit"), F.to_json(f"u{s}").alias("row"))
    ready = ready.filter("v is not null and t is not null")
    max_items, budget, fewest = spec.max_items, spec.max_subsets, spec.fewest
    sizes = ready.groupBy("unit").count().groupBy("count").agg(F.count("*").alias("units")).collect()
    units_n, largest = sum(r["units"] for r in sizes), max((r["count"] for r in sizes), default=0)
    run.costs[t.name] = {"units": units_n, "largest": largest, "bound": sum(upfront(r["count"], max_items) * r["units"] for r in sizes), "budget": budget}
    names_of = ["unit", "n_subsets", "n_best", "x", "take", "row", "chosen", "examined", "sid"]
    by_size = not spec.require and not spec.rank and not spec.evidence  # the search itself knows the best

    whole = lambda v: int(Decimal(v).scaleb(scale))

    def best(unit: str, target: str, members: list, budget: int) -> tuple[list[tuple], int]:
        xs, row = [m["x"] for m in members], [m["row"] for m in members]
        seen: dict = {}
        copies = [seen.setdefault(x, len(seen)) for x in xs]
        found, examined = search([whole(m["v"]) for m in members], copies, whole(target), max_items, budget)
        out = []
        if found and not by_size:
            out = [(unit, None, None, xs[i], None, row[i], None, None, k) for k, f in enumerate(found) for i in f]
        elif found:
            least = min(map(len, found))
            top = [f for f in found if len(f) == least] if fewest else found
            used = {i for f in top for i in f}
            for i in sorted(used):
                group = [j for j in used if copies[j] == copies[i]]
                out.append((unit, len(found), len(top), xs[i], sum(copies[j] == copies[i] for j in top[0]) if len(top) == 1 else len(group), row[i], len(top) == 1, None, None))
        return out, examined

    def searched(batches):
        import pandas as pd

        spent = 0
        for pdf in batches:
            out, before = [], spent
            for unit, target, members in zip(pdf["unit"], pdf["t"], pdf["members"]):
                try:
                    rows, examined = best(unit, target, list(members), budget - spent)
                except RunError:  # the rest isn't searched: the run stops
                    rows, examined = [], budget - spent + 1
                out += rows
                spent += examined
                if spent > budget:
                    break
            out.append((None, None, None, None, None, None, None, spent - before, None))
            out = pd.DataFrame(out, columns=names_of)
            yield out.astype({c: "Int64" for c in ("n_subsets", "n_best", "take", "examined", "sid")} | {"chosen": "boolean"})
            if spent > budget:
                return

    packed = ready.groupBy("unit").agg(F.min("t").alias("t"), F.sort_array(F.collect_list(F.struct("x", "row", "v"))).alias("members"))
    got = run.scratch.keep(packed.mapInPandas(searched, "unit string, n_subsets long, n_best long, x string, take long, row string, chosen boolean, examined long, sid long"))
    examined = got.agg(F.coalesce(F.sum("examined"), F.lit(0))).first()[0]
    run.costs[t.name]["examined"] = examined
    if examined > budget:
        raise RunError("L315", f"tier {t.name} examined {examined} subsets of up to {max_items} rows ({units_n} units, the largest with {largest} rows), more than {budget}; block or require more, or lower max_items")
    got = got.filter("examined is null").drop("examined")
    shown = None
    if by_size:
        got = got.drop("sid")
    else:
        got, shown = _ranked(run, spec, units, rows, got, s, o)
    # copies are shared out in unit order; a kind of row that units need more often than it is there makes them ambiguous
    need = got.select("unit", "x", "take", "n_best").distinct()
    supply = run._available(s).groupBy(F.to_json("_ex").alias("x")).agg(F.count("*").alias("there"))
    wanted = need.groupBy("x").agg(F.sum("take").alias("wanted")).join(supply, "x").withColumn("short", F.col("wanted") > F.col("there"))
    state = need.join(wanted, "x").groupBy("unit").agg(F.max("short").alias("short"), F.max("n_best").alias("n_best"))
    good = state.filter("not short and n_best = 1").select("unit")
    w = Window.partitionBy("x").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = need.join(good, "unit", "left_semi").withColumn("upto", F.sum("take").over(w)).select("unit", "x", (F.col("upto") - F.col("take")).alias("from"), "upto")
    numbered = run._available(s).select(F.col("_id").alias(f"u{s}"), F.to_json("_ex").alias("x")).withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy(f"u{s}")))
    names = cand.select(F.to_json(f"u{o}").alias("unit"), f"u{o}").distinct()
    links = run.scratch.keep(share.join(numbered, "x").filter("i > from and i <= upto").join(names, "unit").select("ua", "ub", "x"))
    doubt = state.filter("short or n_best > 1").select("unit")
    amb = got.join(doubt, "unit", "left_semi").select("unit", "row").distinct().join(names, "unit").join(cand.select(f"u{s}", F.to_json(f"u{s}").alias("row")).distinct(), "row")
    amb = run.scratch.keep(amb.select("ua", "ub", F.concat(F.lit(o), F.col("unit")).alias("g")))
    # copies that no unit took
    kinds = links.groupBy("x").agg(F.min(f"u{s}").alias("of"))
    spare = numbered.join(kinds, "x").join(links.select(f"u{s}").distinct(), f"u{s}", "left_anti").join(amb.select(f"u{s}").distinct(), f"u{s}", "left_anti").select(F.col(f"u{s}").alias("u"), "of")
    counts = got.select("unit", "row", F.col("n_subsets").alias(f"candidates_{o}"))
    log = cand.withColumns({"unit": F.to_json(f"u{o}"), "row": F.to_json(f"u{s}")}).join(counts, ["unit", "row"], "left")
    if spec.evidence:  # of the rows of a unit's only best combination
        log = log.join(got.filter("chosen").select("unit", "row", F.lit(True).alias("_in")), ["unit", "row"], "left").join(shown, "unit", "left")
        log = log.withColumns({f"e_{k}": F.when(F.col("_in"), F.col(f"e_{k}")) for k in spec.evidence}).drop("_in")
    log = log.withColumns({f"candidates_{o}": F.coalesce(f"candidates_{o}", F.lit(0).cast("long")), f"candidates_{s}": F.lit(1).cast("long"), "candidate_rank": F.lit(1)})
    run.rounds[t.name] = 1
    run.record(index, t, run.scratch.keep(log.drop("unit", "row", "_amount", "_target")), links, {s: spare}, amb, *((grouped, None) if o == "a" else (None, grouped)))


def _members(run, t, units: DataFrame, rows: DataFrame, s: str, o: str) -> DataFrame:
    """Pairs of a unit and a row that share the blocking keys and pass the row-level conditions."""
    from ledgerloom.operators.reconcile import _all

    block = run.policy.block if t.block is None else t.block
    cond = _all([F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in block] + list(t.require))
    left, right = (units, rows) if o == "a" else (rows, units)
    extra = [c.alias(f"e_{k}") for k, c in t.evidence.items()] + [F.coalesce(c, F.lit(False)).alias(f"f_{k}") for k, c in t.flags.items()]
    return left.alias("a").join(right.alias("b"), cond).select(
        F.col("a._unit").alias("ua"), F.col("b._unit").alias("ub"), F.col("a._ex").alias("xa"), F.col("b._ex").alias("xb"),
        F.col(f"{s}.{t.subset.amount}").alias("_amount"), F.col(f"{o}.{t.subset.target}").alias("_target"), *extra,
    )


def _ranked(run, spec, units: DataFrame, rows: DataFrame, got: DataFrame, s: str, o: str) -> tuple[DataFrame, DataFrame]:
    """The best combinations of each unit, as the search gives them, and the evidence of units with one best.

    Aggregates over each combination's rows are columns of the side; conditions and ranks are evaluated on pairs of a unit and a combination.
    """
    from ledgerloom.operators.reconcile import _all

    members = got.select("unit", "sid", "row").join(rows.withColumn("row", F.to_json("_id")), "row")
    one = members.groupBy("unit", "sid").agg(F.count("*").alias("_size"), *[c.alias(n) for n, c in spec.lift.items()]).alias(s)
    other = units.withColumn("_json", F.to_json("_unit")).alias(o)
    order = ([F.col("_size").asc()] if spec.fewest else []) + [F.col(f"_k{i}").desc_nulls_last() if desc else F.col(f"_k{i}").asc_nulls_last() for i, (_, desc) in enumerate(spec.rank)]
    fit = one.join(other, F.col(f"{s}.unit") == F.col(f"{o}._json")).filter(_all(spec.require))
    fit = fit.select(F.col(f"{s}.unit").alias("unit"), F.col(f"{s}.sid").alias("sid"), F.col(f"{s}._size").alias("_size"), *[e.alias(f"_k{i}") for i, (e, _) in enumerate(spec.rank)], *[e.alias(f"e_{k}") for k, e in spec.evidence.items()])
    w = Window.partitionBy("unit")
    fit = fit.withColumn("n_subsets", F.count("*").over(w)).withColumn("place", F.rank().over(w.orderBy(*order)) if order else F.lit(1))
    best = run.scratch.keep(fit.filter("place = 1").withColumn("n_best", F.count("*").over(w)))
    used = got.select("unit", "sid", "x", "row").join(best.select("unit", "sid", "n_subsets", "n_best"), ["unit", "sid"]).drop("sid").distinct()
    used = used.withColumn("take", F.count("*").over(Window.partitionBy("unit", "x"))).withColumn("chosen", F.col("n_best") == 1)
    return run.scratch.keep(used.select("unit", "n_subsets", "n_best", "x", "take", "row", "chosen")), best.filter("n_best = 1").select("unit", *[f"e_{k}" for k in spec.evidence])
