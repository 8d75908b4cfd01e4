"""Reconciliation: tiers of policies that match the rows of two relations without ever breaking a tie by storage order.

Rows that are equal in every column the policy reads are one class; decisions are made between classes, so their number does
not grow with interchangeable rows. Every step is a join, window or aggregation keyed by class, group or block; the loop over
rounds is driven from here and keeps its state in scratch tables. Conditions are Columns over ``a.x`` and ``b.x``.

Units that only have each other are linked as they are; classes and rounds see the others. Candidates hold no columns of the rows;
outputs join them again by identity, each when it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.plans.scratch import Scratch, by_real_sizes, numbered
from ledgerloom.relation import Relation

SHAPES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


@dataclass(frozen=True)
class Subset:
    """One unit of the other side equals a combination of up to ``max_items`` rows of ``side``: sum(``amount``) == ``target`` of the unit.

    ``lift``: aggregates by name over a combination's rows, which ``require`` and ``rank`` (best first) read as side.name, as does ``evidence``.
    ``fewest`` ranks by the number of rows first.
    """

    side: str
    amount: str
    target: str
    max_items: int = 8
    max_subsets: int = 2_000_000
    fewest: bool = True
    lift: dict[str, Column] = field(default_factory=dict)
    require: tuple[Column, ...] = ()
    rank: tuple[tuple[Column, bool], ...] = ()
    evidence: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Tier:
    """``rank``: (expression, descending), best first. ``group_a`` / ``group_b``: group keys of a rollup, with ``lift``: aggregates by
    name that conditions read as a.name / b.name."""

    name: str
    require: tuple[Column, ...] = ()
    block: tuple[tuple[str, str], ...] | None = None
    rank: tuple[tuple[Column, bool], ...] = ()
    evidence: dict[str, Column] = field(default_factory=dict)
    flags: dict[str, Column] = field(default_factory=dict)
    group_a: tuple[str, ...] = ()
    group_b: tuple[str, ...] = ()
    lift_a: dict[str, Column] = field(default_factory=dict)
    lift_b: dict[str, Column] = field(default_factory=dict)
    subset: Subset | None = None
    reason: str = ""


@dataclass(frozen=True)
class Policy:
    tiers: tuple[Tier, ...]
    block: tuple[tuple[str, str], ...] = ()
    cardinality: str = "one_to_one"
    consume: str = "both"
    ambiguity: str = "hold"
    duplicates: str = "hold"


def _all(conditions) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def _any(conditions) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def read_columns(expressions, side: str) -> set[str]:
    """Names that expressions read as ``side.name``, from their syntax trees."""
    found: set[str] = set()

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedAttribute":
            parts = node.nameParts()
            if parts.size() > 1 and parts.apply(0).lower() == side:
                found.add(parts.apply(1))
        elif kind == "SqlExpression":  # an expression that was given as text
            parser = SparkSession.active()._jsparkSession.sessionState().sqlParser()
            walk(parser.parseExpression(node.expression()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    for e in expressions:
        walk(e._jc.node())
    return found


class Run:
    """One reconciliation. After ``run()``: matches, unmatched_a, unmatched_b, ambiguous, candidates, summary, rounds; costs of subset
    tiers. ``names`` are the sides' names in the columns of the outputs. An output without rows has its columns, too."""

    def __init__(self, a: Relation, b: Relation, policy: Policy, names: tuple[str, str] = ("a", "b")):
        if not policy.tiers:
            raise AnalysisError("L301", "a reconciliation has a tier at least")
        self.names = dict(zip("ab", names))
        for t in policy.tiers:
            if t.subset and not 1 <= t.subset.max_items <= 16:
                raise AnalysisError("L313", "a subset has 1 to 16 items")
            if t.subset and policy.cardinality != "one_to_one":
                raise AnalysisError("L313", "subset tiers need one_to_one")
        if policy.cardinality not in SHAPES or policy.consume not in ("both", "a", "b", "none"):
            raise AnalysisError("L301", "unknown cardinality or consume")
        self.policy, self.spark = policy, a.df.sparkSession
        self.scratch = Scratch(self.spark, "reconcile")
        self.rounds: dict[str, int] = {}
        self.costs: dict[str, dict] = {}
        with by_real_sizes(self.spark):
            self.relations = {"a": self._identified(a, "a"), "b": self._identified(b, "b")}
            self.sides = {s: self._setup(s) for s in "ab"}
            self.sizes = {s: self._check_identity(s) if r.identity else self.sides[s].count() for s, r in (("a", a), ("b", b))}
        self.parts: dict[str, list[DataFrame]] = {"links": [], "dups_a": [], "dups_b": [], "ambiguous": [], "candidates": []}

    # setup

    def _identified(self, r: Relation, side: str) -> Relation:
        """Without an identity rows are numbered by their content."""
        if r.identity:
            return r
        row = f"{self.names[side]}_row"
        order = [F.col(f"`{c}`").asc_nulls_last() for c in r.columns]
        return r.with_(numbered(self.scratch, r.df, order, row), identity=(row,))

    def _policy_columns(self, side: str) -> list[str]:
        r, p = self.relations[side], self.policy
        exprs = [e for t in p.tiers for e in (*t.require, *[x for x, _ in t.rank], *t.evidence.values(), *t.flags.values())]
        exprs += [e for t in p.tiers if t.subset for e in (*t.subset.require, *[x for x, _ in t.subset.rank], *t.subset.evidence.values())]
        names = read_columns(exprs, side) | {pair[side == "b"] for pair in p.block} | {pair[side == "b"] for t in p.tiers for pair in t.block or ()}
        names |= {k for t in p.tiers for k in (t.group_a if side == "a" else t.group_b)}
        names |= {x for t in p.tiers if t.subset for x in ([t.subset.amount] if t.subset.side == side else [t.subset.target])}
        return sorted(c for c in r.columns if c.lower() in {n.lower() for n in names})

    def _setup(self, side: str) -> DataFrame:
        r = self.relations[side]
        rest = [c for c in r.columns if c not in r.identity]
        pol = self._policy_columns(side)
        if self.policy.consume != "both":  # which row paired with which decides what later tiers can do
            pol = sorted({*pol, *r.identity})
        rows = self.scratch.keep(r.df)
        return rows.withColumns({"_id": F.struct(*r.identity), "_cls": F.struct(*pol) if pol else F.struct(F.lit(1).alias("one")), "_ex": F.struct(*rest) if rest else F.struct(F.lit(1).alias("one"))})

    def _check_identity(self, side: str) -> int:
        """The number of rows."""
        r = self.relations[side]
        n, ids, nulls = self.sides[side].agg(F.count("*"), F.countDistinct("_id"), F.count_if(_any(F.col(i).isNull() for i in r.identity))).first()
        if n != ids or nulls:
            raise RunError("L310", f"the identity of side {side} has nulls or repeats")
        return n

    # state

    def _union(self, what: str) -> DataFrame | None:
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), self.parts[what]) if self.parts[what] else None

    def _gone(self, side: str) -> DataFrame | None:
        """Ids that later tiers don't see."""
        p, out = self.policy, []
        if p.consume in ("both", side) and (x := self._union("links")) is not None:
            out.append(x.select(F.col(f"{side}id").alias("_id")))
        if p.duplicates == "hold" and (x := self._union(f"dups_{side}")) is not None:
            out.append(x.select("_id"))
        if p.ambiguity == "hold" and (x := self._union("ambiguous")) is not None:
            chooser = {"many_to_one": "a", "one_to_many": "b"}.get(p.cardinality)
            if chooser in (None, side):
                out.append(x.select(F.col(f"{side}id").alias("_id")))
        return reduce(lambda x, y: x.unionByName(y), out) if out else None

    def _available(self, side: str) -> DataFrame:
        gone = self._gone(side)
        return self.sides[side] if gone is None else self.sides[side].join(gone, "_id", "left_anti")

    # candidates

    def _units(self, tier: Tier, side: str) -> tuple[DataFrame, DataFrame | None]:
        """Rows, or groups as rows of their own with their members (_unit, _id)."""
        rows = self._available(side)
        keys, lift = (tier.group_a, tier.lift_a) if side == "a" else (tier.group_b, tier.lift_b)
        if not keys:
            return rows.withColumn("_unit", F.col("_id")), None
        rows = rows.filter(_all(F.col(k).isNotNull() for k in keys))
        groups = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in lift.items()])
        groups = groups.withColumn("_unit", F.struct(*keys)).withColumn("_cls", F.col("_unit")).withColumn("_ex", F.col("_unit"))
        return groups, rows.select(F.struct(*keys).alias("_unit"), "_id")

    def _candidates(self, tier: Tier, index: int, ua: DataFrame, ub: DataFrame) -> DataFrame:
        """Unit pairs that share the blocking keys and pass every require, with counts, the pair's rank and whether it is ``sure``: a pair
        that is linked whatever the others are."""
        block = self.policy.block if tier.block is None else tier.block
        cond = _all([F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in block] + list(tier.require))
        ranks = [e.alias(f"_r{i}") for i, (e, _) in enumerate(tier.rank)]
        extra = [c.alias(f"e_{k}") for k, c in tier.evidence.items()] + [F.coalesce(c, F.lit(False)).alias(f"f_{k}") for k, c in tier.flags.items()]
        out = ua.alias("a").join(ub.alias("b"), cond).select(
            F.col("a._unit").alias("ua"), F.col("b._unit").alias("ub"), *ranks, *extra
        )
        prior = self._union("links")
        if prior is not None and self.policy.consume != "both" and not tier.group_a and not tier.group_b:
            out = out.join(prior.select(F.col("aid").alias("ua"), F.col("bid").alias("ub")), ["ua", "ub"], "left_anti")
        order = self._order(tier)
        wa, wb = Window.partitionBy("ua"), Window.partitionBy("ub")
        out = out.withColumn("candidates_a", F.count("*").over(wa)).withColumn("candidates_b", F.count("*").over(wb))
        out = out.withColumn("candidate_rank", F.rank().over(wa.orderBy(*order)) if order else F.lit(1))
        one_a, one_b = F.col("candidates_a") == 1, F.col("candidates_b") == 1
        kind = self.policy.cardinality
        if kind == "one_to_one":  # the classes of two that only have each other are they themselves
            return out.withColumn("sure", one_a & one_b)
        if kind == "many_to_many":
            return out.withColumn("sure", F.lit(True))
        w = wa if kind == "many_to_one" else wb
        best = F.col("candidate_rank") if kind == "many_to_one" else F.rank().over(wb.orderBy(*order)) if order else F.lit(1)
        out = out.withColumn("best", best == 1)
        return out.withColumn("sure", F.col("best") & (F.count_if("best").over(w) == 1))

    @staticmethod
    def _order(tier: Tier) -> list[Column]:
        return [F.col(f"_r{i}").desc_nulls_last() if desc else F.col(f"_r{i}").asc_nulls_last() for i, (_, desc) in enumerate(tier.rank)]

    # selection

    @staticmethod
    def _class_counts(rows: DataFrame, s: str) -> DataFrame:
        """Of each class the rows, and whether they are all alike."""
        return rows.groupBy(F.col("c").alias(f"c{s}")).agg(F.count("*").alias(f"n{s}"), F.min("x").eqNullSafe(F.max("x")).alias(f"k{s}"))

    def _open_rows(self, tier: Tier, s: str, units: DataFrame) -> DataFrame:
        """u, c, x: unit, class and what must be equal in copies, of the units (u)."""
        if tier.group_a if s == "a" else tier.group_b:
            return units.select("u", F.col("u").alias("c"), F.col("u").alias("x"))
        return units.join(self.sides[s].select(F.col("_id").alias("u"), F.col("_cls").alias("c"), F.col("_ex").alias("x")), "u")

    def _one_to_one(self, tier: Tier, cand: DataFrame) -> tuple[DataFrame | None, dict[str, DataFrame], DataFrame | None]:
        """Rounds of mutual best classes and stars, then ties; returns links, duplicates of each side and ambiguous pairs (units).

        Pairs that are sure are left out. Rounds only see rows and pairs that are still open.
        """
        ranks = [f"_r{i}" for i in range(len(tier.rank))]
        order = self._order(tier) or [F.lit(1)]
        rest = cand.filter("not sure").select("ua", "ub", *ranks)
        links, dups, amb, n, left = [], {"a": [], "b": []}, [], 0, None
        if not rest.isEmpty():
            left = {s: self.scratch.keep(self._open_rows(tier, s, rest.select(F.col(f"u{s}").alias("u")).distinct())) for s in "ab"}
            for s in "ab":
                rest = rest.join(left[s].select(F.col("u").alias(f"u{s}"), F.col("c").alias(f"c{s}")), f"u{s}")
            pairs = self.scratch.keep(rest.select("ca", "cb", *ranks).distinct())
        while left is not None:
            act = pairs.join(self._class_counts(left["a"], "a"), "ca").join(self._class_counts(left["b"], "b"), "cb")
            wa, wb = Window.partitionBy("ca"), Window.partitionBy("cb")
            act = act.withColumn("ra", F.rank().over(wa.orderBy(*order))).withColumn("rb", F.rank().over(wb.orderBy(*order)))
            act = act.withColumn("ta", F.sum((F.col("ra") == 1).cast("int")).over(wa)).withColumn("tb", F.sum((F.col("rb") == 1).cast("int")).over(wb))
            act = self.scratch.keep(act)
            if act.isEmpty():
                break
            n += 1
            best_a, best_b = (F.col("ra") == 1) & (F.col("ta") == 1), (F.col("rb") == 1) & (F.col("tb") == 1)
            enough = (F.col("na") == F.col("nb")) | ((F.col("na") > F.col("nb")) & F.col("ka")) | ((F.col("nb") > F.col("na")) & F.col("kb"))
            pair = act.filter(best_a & best_b)
            decided = [pair.filter(enough).select(F.struct(F.lit("p").alias("kind"), F.to_json("ca").alias("x"), F.to_json("cb").alias("y")).alias("g"), "ca", "cb")]
            undecided = pair.filter(~enough).select("ca", "cb", F.concat(F.lit("p"), F.to_json("ca"), F.to_json("cb")).alias("g"))
            for s, o, leaf_best in (("a", "b", best_b), ("b", "a", best_a)):
                w = Window.partitionBy(f"c{s}")
                star = act.filter((F.col(f"r{s}") == 1) & (F.col(f"t{s}") > 1)).withColumn("all", F.min(leaf_best.cast("int")).over(w)).withColumn("leaves", F.sum(f"n{o}").over(w))
                ok = (F.col("all") == 1) & ((F.col(f"n{s}") == F.col("leaves")) | ((F.col(f"n{s}") > F.col("leaves")) & F.col(f"k{s}")))
                decided.append(star.filter(ok).select(F.struct(F.lit(s).alias("kind"), F.to_json(f"c{s}").alias("x"), F.lit("").alias("y")).alias("g"), "ca", "cb"))
            groups = self.scratch.keep(reduce(lambda x, y: x.unionByName(y), decided))
            undecided = self.scratch.keep(undecided)
            stuck = groups.isEmpty() and undecided.isEmpty()
            if stuck:
                tied = act.filter(((F.col("ra") == 1) & (F.col("ta") > 1)) | ((F.col("rb") == 1) & (F.col("tb") > 1)))
                by_a = (F.col("ra") == 1) & (F.col("ta") > 1)
                undecided = self.scratch.keep(tied.select("ca", "cb", F.when(by_a, F.concat(F.lit("a"), F.to_json("ca"))).otherwise(F.concat(F.lit("b"), F.to_json("cb"))).alias("g")))
            # members of decided groups, numbered in identity order
            members = {}
            for s in "ab":
                m = groups.select("g", F.col(f"c{s}").alias("c")).distinct().join(left[s], "c")
                members[s] = m.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("u"))).withColumn("first", F.min("u").over(Window.partitionBy("g")))
            a, b = members["a"].select("g", "i", F.col("u").alias("ua"), F.col("first").alias("fa")), members["b"].select("g", "i", F.col("u").alias("ub"), F.col("first").alias("fb"))
            both = self.scratch.keep(a.join(b, ["g", "i"], "full"))
            firsts = both.groupBy("g").agg(F.min("fa").alias("fa0"), F.min("fb").alias("fb0"))
            links.append(both.filter(F.col("ua").isNotNull() & F.col("ub").isNotNull()).select("ua", "ub"))
            over = both.filter(F.col("ua").isNull() | F.col("ub").isNull()).join(firsts, "g")
            for s in "ab":
                dups[s].append(over.filter(F.col(f"u{s}").isNotNull()).select(F.col(f"u{s}").alias("u"), F.col(f"f{s}0").alias("of")))
            pairs_amb = undecided.join(left["a"].select(F.col("c").alias("ca"), F.col("u").alias("ua")), "ca").join(left["b"].select(F.col("c").alias("cb"), F.col("u").alias("ub")), "cb")
            pairs_amb = self.scratch.keep(pairs_amb.select("ua", "ub", "g"))
            amb.append(pairs_amb)
            # what is still open
            pairs = act.select("ca", "cb", *ranks)
            for s in "ab":
                gone = both.filter(F.col(f"u{s}").isNotNull())
                if self.policy.duplicates == "continue":  # left-over copies stay
                    gone = gone.filter(F.col("ua").isNotNull() & F.col("ub").isNotNull())
                gone = gone.select(F.col(f"u{s}").alias("u")).unionByName(pairs_amb.select(F.col(f"u{s}").alias("u"))).distinct()
                left[s] = self.scratch.keep(left[s].join(gone, "u", "left_anti"))
        self.rounds[tier.name] = n
        join = lambda xs: reduce(lambda x, y: x.unionByName(y), xs) if xs else None
        return join(links), {s: join(dups[s]) for s in "ab"}, join(amb)

    def _chooser(self, tier: Tier, cand: DataFrame, s: str, o: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        """Each unit of side s picks its best on side o; equal copies go to the lowest id, other ties are ambiguous. Links without the sure ones."""
        tied = cand.filter("best and not sure").join(self._open_rows(tier, o, cand.filter("best and not sure").select(F.col(f"u{o}").alias("u")).distinct()).select(F.col("u").alias(f"u{o}"), F.col("x").alias("x")), f"u{o}")
        best = tied.groupBy(f"u{s}").agg(F.countDistinct("x").alias("kinds"), F.min(f"u{o}").alias("pick"), F.collect_list(f"u{o}").alias("all"))
        best = self.scratch.keep(best)
        links = best.filter("kinds = 1").select(F.col(f"u{s}"), F.col("pick").alias(f"u{o}")).select("ua", "ub")
        passed = best.filter("kinds = 1").select("pick", F.explode("all").alias("u")).filter("u <> pick")
        taken = links.select(f"u{o}").unionByName(cand.filter("sure").select(f"u{o}"))
        dup = passed.join(taken.select(F.col(f"u{o}").alias("u")), "u", "left_anti").groupBy("u").agg(F.min("pick").alias("of"))
        amb = best.filter("kinds > 1").select(F.col(f"u{s}"), F.explode("all").alias(f"u{o}")).select("ua", "ub", F.concat(F.lit(s), F.to_json(f"u{s}")).alias("g"))
        self.rounds[tier.name] = 1
        return links, {o: dup, s: None}, amb

    # tiers

    def _expand(self, pairs: DataFrame | None, ma: DataFrame | None, mb: DataFrame | None) -> DataFrame | None:
        """Unit pairs as row pairs (aid, bid)."""
        if pairs is None:
            return None
        out = pairs.withColumn("aid", F.col("ua")) if ma is None else pairs.join(ma.select(F.col("_unit").alias("ua"), F.col("_id").alias("aid")), "ua")
        return out.withColumn("bid", F.col("ub")) if mb is None else out.join(mb.select(F.col("_unit").alias("ub"), F.col("_id").alias("bid")), "ub")

    def _tier(self, index: int, tier: Tier) -> None:
        if tier.subset:
            from ledgerloom.operators import subsets

            subsets.tier(self, index, tier)
            return
        ua, ma = self._units(tier, "a")
        ub, mb = self._units(tier, "b")
        cand = self.scratch.keep(self._candidates(tier, index, ua, ub))
        if self.policy.cardinality == "one_to_one":
            links, dups, amb = self._one_to_one(tier, cand)
        elif self.policy.cardinality == "many_to_many":
            links, dups, amb = None, {"a": None, "b": None}, None
        else:
            s, o = ("a", "b") if self.policy.cardinality == "many_to_one" else ("b", "a")
            links, dups, amb = self._chooser(tier, cand, s, o)
        members = {"a": ma, "b": mb}
        self.record(index, tier, cand, links, {s: d for s, d in dups.items() if members[s] is None}, amb, ma, mb)

    def record(self, index: int, tier: Tier, cand: DataFrame, links, dups, amb, ma=None, mb=None) -> None:
        """Put a tier's outcome in the tables of the run."""
        shown = [*[f"e_{k}" for k in (*tier.evidence, *(tier.subset.evidence if tier.subset else ()))], *[f"f_{k}" for k in tier.flags]]
        info = [*shown, "flags", "candidates_a", "candidates_b", "candidate_rank", "rank_values", "reason"]
        fl = F.array_join(F.array(*[F.when(F.col(f"f_{k}"), k) for k in tier.flags]), ",") if tier.flags else F.lit("")
        rv = F.concat_ws(", ", *[F.coalesce(F.col(f"_r{i}").cast("string"), F.lit("null")) for i in range(len(tier.rank))]) if tier.rank else F.lit("")
        said = {"flags": fl, "rank_values": rv, "tier": F.lit(tier.name), "tier_index": F.lit(index), "reason": F.lit(tier.reason or self._reason(tier))}
        cols = ["tier", "tier_index", "a_group", "b_group", "aid", "bid", *info]
        group = lambda c, m: (F.to_json(c) if m is not None else F.lit(None).cast("string"))
        grouped = ma is not None or mb is not None

        def rows(pairs: DataFrame, keep: bool) -> DataFrame:
            """The pairs' rows; what is said of all of them isn't written."""
            out = self._expand(pairs, ma, mb)
            return (self.scratch.keep(out) if keep else out).withColumns({**said, "a_group": group("ua", ma), "b_group": group("ub", mb)})

        self.parts["candidates"].append(rows(cand, False).select(*cols))
        if "sure" in cand.columns:
            self.parts["links"].append(rows(cand.filter("sure"), grouped).select(*cols))
        if links is not None:
            self.parts["links"].append(rows(cand.join(links.select("ua", "ub").distinct(), ["ua", "ub"]), True).select(*cols))
        if amb is not None:
            self.parts["ambiguous"].append(rows(cand.drop("g").join(amb, ["ua", "ub"]), True).select("g", *cols))
        for s, d in dups.items():
            if d is not None:
                self.parts[f"dups_{s}"].append(self.scratch.keep(d.select(F.col("u").alias("_id"), F.col("of").alias("_of"))))

    def _reason(self, tier: Tier) -> str:
        """The tier's policy in words."""
        block = self.policy.block if tier.block is None else tier.block
        plain = lambda e: e._jc.toString()
        parts = [f"same {x}" if x == y else f"{x} is {y}" for x, y in block] + [plain(e) for e in tier.require]
        parts += [f"{tier.subset.amount} adds up to {tier.subset.target}"] if tier.subset else []
        parts += [f"best by {plain(e)}{' descending' if desc else ''}" for e, desc in tier.rank]
        return f"{tier.name}: {'; '.join(parts)}" if parts else tier.name

    def run(self) -> Run:
        with by_real_sizes(self.spark):
            for i, tier in enumerate(self.policy.tiers):
                self._tier(i, tier)
            self._outputs()
        return self

    # outputs

    def _ids(self, side: str, column: str) -> list[Column]:
        name = self.names[side]
        return [F.col(f"{column}.`{i}`").alias(f"{name}_{i}" if i != f"{name}_row" else i) for i in self.relations[side].identity]

    def _shown(self, df: DataFrame) -> list[Column]:
        """Evidence, then flags, a column each; names that the outputs have already stay as they are."""
        return [F.col(f"`{c}`").alias(c[2:]) for c in df.columns if c.startswith("e_")] + [F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c[2:]) for c in df.columns if c.startswith("f_")]

    def _others(self, side: str) -> list[str]:
        r = self.relations[side]
        return [c for c in r.columns if c not in r.identity]

    def _with_sides(self, df: DataFrame, columns: list[Column]) -> DataFrame:
        """The columns, then those of both sides' rows but for their identities. It runs where the caller reads it: nothing is broadcast."""
        for s in "ab":
            side = self.sides[s].select(F.col("_id").alias(f"{s}id"), F.struct(*[F.col(f"`{c}`") for c in self._others(s)] or [F.lit(1).alias("none")]).alias(f"{s}row"))
            df = df.join(side.hint("merge"), f"{s}id")
        return df.select(*columns, *[F.col(f"{s}row.`{c}`").alias(f"{self.names[s]}_{c}") for s in "ab" for c in self._others(s)])

    def _outputs(self) -> None:
        self._cand = self._union("candidates")
        nothing = self._cand.limit(0)
        links, amb = self._union("links"), self._union("ambiguous")
        self._links = links = nothing if links is None else links
        self._amb = amb = nothing.withColumn("g", F.lit("")) if amb is None else amb
        self._head = ["tier", "tier_index", "a_group", "b_group", *self._ids("a", "aid"), *self._ids("b", "bid")]
        self.matches = self._with_sides(links, [*self._head, *self._shown(links), "flags", "candidates_a", "candidates_b", "candidate_rank", "rank_values", "reason"])
        self.status, self._kinds = {}, {}
        for s in "ab":
            st = self._status(s)
            self._verify(s, st)
            self.status[s] = st.select("_id", "status", "_of")
            of = F.when(F.col("status") == "duplicate", F.concat_ws("|", *[F.col(f"_of.`{i}`").cast("string") for i in self.relations[s].identity]))
            rest = self.status[s].filter(F.col("status").isin("unmatched", "duplicate")).select("_id", F.col("status").alias("match_status"), of.alias("duplicate_of"))
            setattr(self, f"unmatched_{s}", self.sides[s].join(rest.hint("merge"), "_id").select("match_status", "duplicate_of", *[F.col(f"`{c}`") for c in self.relations[s].columns]))

    def _status(self, s: str) -> DataFrame:
        """_id, status, _of, and what _verify() looks at, from one aggregation over the side's rows, its links and doubts."""
        o = "b" if s == "a" else "a"
        subset = any(t.subset for t in self.policy.tiers)
        none = F.lit(None).cast("long")
        mine = F.lit(not subset) | F.col(f"{s}_group").isNotNull()
        unit = F.when(mine, F.xxhash64(F.col(f"{o}_group").isNull(), f"{o}_group", F.when(F.col(f"{o}_group").isNull(), F.col(f"{o}id"))))
        rows = self.sides[s].select("_id", F.lit(1).alias("own"), F.lit(0).alias("m"), F.lit(0).alias("q"), none.alias("unit"), none.alias("tier"), F.lit(0).alias("plain"))
        linked = self._links.select(F.col(f"{s}id").alias("_id"), F.lit(0).alias("own"), F.lit(1).alias("m"), F.lit(0).alias("q"), unit.alias("unit"), F.when(mine, F.col("tier_index")).cast("long").alias("tier"), (F.col("a_group").isNull() & F.col("b_group").isNull()).cast("int").alias("plain"))
        every = rows.unionByName(linked)
        chooser = {"many_to_one": "a", "one_to_many": "b"}.get(self.policy.cardinality)
        if self.parts["ambiguous"] and chooser in (None, s):
            every = every.unionByName(self._amb.select(F.col(f"{s}id").alias("_id"), F.lit(0).alias("own"), F.lit(0).alias("m"), F.lit(1).alias("q"), none.alias("unit"), none.alias("tier"), F.lit(0).alias("plain")))
        st = every.groupBy("_id").agg(F.sum("own").alias("own"), F.max("m").alias("m"), F.max("q").alias("q"), ((F.min("unit") != F.max("unit")) | (F.min("tier") != F.max("tier"))).alias("twice"), F.max("plain").alias("plain"))
        dups = self._union(f"dups_{s}")
        if dups is None:
            st = st.withColumn("_of", F.lit(None).cast(self.sides[s].schema["_id"].dataType))
        else:
            st = st.join(dups.groupBy("_id").agg(F.min("_of").alias("_of")), "_id", "left")
        status = F.when(F.col("m") == 1, "matched").when(F.col("q") == 1, "ambiguous").when(F.col("_of").isNotNull(), "duplicate").otherwise("unmatched")
        return self.scratch.keep(st.select("_id", status.alias("status"), "_of", "own", "m", (F.coalesce("twice", F.lit(False)) & (F.col("plain") == 1)).alias("twice")))

    @cached_property
    def ambiguous(self) -> DataFrame:
        with by_real_sizes(self.spark):
            groups = numbered(self.scratch, self._amb.select("tier_index", "g").distinct(), [F.col("tier_index"), F.col("g")], "ambiguity_id")
        return self._with_sides(self._amb.join(groups.hint("merge"), ["tier_index", "g"]), ["tier", "tier_index", "ambiguity_id", *self._head[2:], *self._shown(self._amb), "candidate_rank", "rank_values"])

    @cached_property
    def candidates(self) -> DataFrame:
        on = ["tier_index", "aid", "bid"]
        hit = self._links.select(*on).distinct().withColumn("_m", F.lit(True))
        doubt = self._amb.select(*on).distinct().withColumn("_q", F.lit(True))
        outcome = F.when(F.col("_m"), "matched").when(F.col("_q"), "ambiguous").otherwise("not selected")
        return self._cand.join(hit.hint("merge"), on, "left").join(doubt.hint("merge"), on, "left").select(*self._head, outcome.alias("outcome"), "candidate_rank", "rank_values", "candidates_a", "candidates_b", *self._shown(self._cand))

    @cached_property
    def summary(self) -> DataFrame:
        """position, step, tier_index, pairs, a_rows, b_rows."""
        schema = "position long, step string, tier_index long, pairs long, a_rows long, b_rows long"
        p, per, n = self.policy, {}, len(self.policy.tiers)
        links = self._links.groupBy("tier_index")
        # rows that are in one pair are as many as the pairs; _verify() has seen to it
        single = p.cardinality == "one_to_one" and p.consume == "both" and not any(t.subset or t.group_a or t.group_b for t in p.tiers)
        with by_real_sizes(self.spark):
            for r in (links.agg(F.count("*").alias("p")) if single else links.agg(F.count("*").alias("p"), F.countDistinct("aid").alias("a"), F.countDistinct("bid").alias("b"))).collect():
                per[r["tier_index"]] = (r["p"],) * 3 if single else (r["p"], r["a"], r["b"])
            rows = [(i + 1, t.name, i, *per.get(i, (0, 0, 0))) for i, t in enumerate(p.tiers)]
            doubts = self._amb.select("aid", "bid").distinct().count() if self.parts["ambiguous"] else 0
        for k, step in enumerate(("ambiguous", "duplicate", "unmatched")):
            rows.append((n + 1 + k, step, None, doubts if step == "ambiguous" else 0, self._kinds["a"].get(step, 0), self._kinds["b"].get(step, 0)))
        rows.append((n + 4, "total", None, sum(r[3] for r in rows[:n]), sum(self._kinds["a"].values()), sum(self._kinds["b"].values())))
        return self.spark.createDataFrame(rows, schema)

    def _verify(self, s: str, st: DataFrame) -> None:
        """Every row has one status, no withheld duplicate is matched, and in one_to_one a row is in one pair or one group."""
        seen = st.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("own") != 1).alias("strange"), F.count_if("twice").alias("twice"), F.count_if((F.col("m") == 1) & F.col("_of").isNotNull()).alias("held")).collect()
        self._kinds[s] = {r["status"]: r["n"] for r in seen}
        if sum(self._kinds[s].values()) != self.sizes[s] or any(r["strange"] for r in seen):
            raise RunError("L400", f"a row of side {s} has no status, or several")
        if self.policy.duplicates == "hold" and any(r["held"] for r in seen):
            raise RunError("L400", f"a duplicate of side {s} is matched")
        if self.policy.cardinality == "one_to_one" and self.policy.consume == "both" and any(r["twice"] for r in seen):
            raise RunError("L400", f"a row of side {s} is matched twice")
