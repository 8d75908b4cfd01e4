"""The pipeline's steps. Each takes and returns a Relation and only declares a plan; Catalyst chooses how to run it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ledgerloom import types as L
from ledgerloom.errors import AnalysisError
from ledgerloom.functions import aggregate as A
from ledgerloom.functions.scalar import mapped
from ledgerloom.relation import Relation, order_by

Expr = str | Column


def _column(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


def _distinct_names(names: list[str]) -> None:
    low = [n.lower() for n in names]
    if dup := {n for n in low if low.count(n) > 1}:
        raise AnalysisError("L003", f"columns given twice: {', '.join(sorted(dup))}")


def _refs(c: Expr) -> tuple[str, ...]:
    return (c,) if isinstance(c, str) else ()


def select(r: Relation, /, *names: str, **made: Expr) -> Relation:
    """Exactly these columns; the order is cleared, an identity that isn't wholly kept is lost."""
    cols = [r.spelled(n) for n in names]
    _distinct_names([*cols, *made])
    df = r.df.select(*cols, *[_column(e).alias(k) for k, e in made.items()])
    kept = {c.lower() for c in cols}
    return r.with_(df, identity=r.identity if {i.lower() for i in r.identity} <= kept else (), sort=(), lineage={c: (c,) for c in cols} | {k: _refs(e) for k, e in made.items()})


def drop(r: Relation, *names: str) -> Relation:
    gone = {r.spelled(n).lower() for n in names}
    left = [c for c in r.columns if c.lower() not in gone]
    if not left:
        raise AnalysisError("L116", "drop leaves no column")
    return r.with_(r.df.select(*left), identity=() if gone & {i.lower() for i in r.identity} else r.identity, sort=())


def rename(r: Relation, /, **pairs: str) -> Relation:
    """``rename(r, old="new")``; identity and order follow."""
    new = {r.spelled(k): v for k, v in pairs.items()}
    names = [new.get(c, c) for c in r.columns]
    _distinct_names(names)
    return r.with_(r.df.toDF(*names), identity=tuple(new.get(i, i) for i in r.identity), sort=tuple((new.get(k, k), d) for k, d in r.sort))


def derive(r: Relation, /, **made: Expr) -> Relation:
    """New or replaced columns; a later one may use an earlier one. Columns that don't depend on each other are one projection."""
    df, touched = r.df, {k.lower() for k in made}
    for name, e in made.items():
        spelled = r.spelled(name) if r.has(name) else name
        df = df.withColumn(spelled, _column(e))
    return r.with_(
        df,
        identity=() if touched & {i.lower() for i in r.identity} else r.identity,
        sort=() if touched & {k.lower() for k, _ in r.sort} else r.sort,
        lineage=r.lineage | {k: _refs(e) for k, e in made.items()},
    )


def filter_(r: Relation, condition: Expr) -> Relation:
    return r.with_(r.df.filter(condition))


def normalize(r: Relation, column: str, mapping: dict, otherwise=None, keep_original: bool = False) -> Relation:
    """Values of a column replaced by a mapping; unmapped ones become null, ``otherwise``, or stay."""
    c = r.spelled(column)
    flat = [k for key in mapping for k in (key if isinstance(key, tuple) else (key,))]
    if len(flat) != len(set(flat)):
        raise AnalysisError("L109", "a mapping names a value twice")
    out = r.df.withColumn(c, mapped(F.col(c), mapping, F.col(c) if keep_original else otherwise))
    return r.with_(out, sort=(), identity=() if c.lower() in {i.lower() for i in r.identity} else r.identity)


def distinct(r: Relation) -> Relation:
    return r.with_(r.df.distinct(), sort=())


def union(r: Relation, other: Relation) -> Relation:
    """All rows of both, matched by name without case; types are unified."""
    if {c.lower() for c in r.columns} != {c.lower() for c in other.columns}:
        raise AnalysisError("L119", "union needs the same columns on both sides")
    kinds = {c: L.unify(r.type_of(c), other.type_of(c)) for c in r.columns}
    left = r.df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in r.columns])
    right = other.df.select(*[F.col(other.spelled(c)).cast(kinds[c]).alias(c) for c in r.columns])
    return r.with_(left.unionByName(right), identity=(), sort=())


def sort(r: Relation, *keys: str) -> Relation:
    """Column names, ``-name`` for descending."""
    parsed = tuple((r.spelled(k.lstrip("-")), k.startswith("-")) for k in keys)
    return r.with_(r.df.orderBy(*order_by(list(parsed), r.columns)), sort=parsed)


def limit(r: Relation, n: int) -> Relation:
    """The first rows of the declared order; planned as a top-k, never as a whole sort."""
    if not r.sort:
        raise AnalysisError("L118", "limit needs a sort before it")
    return r.with_(r.df.orderBy(*order_by(list(r.sort), r.columns)).limit(n))


# grouping and windows


def aggregate(r: Relation, by: tuple[str, ...] = (), /, **made: Column) -> Relation:
    """One row per group, or one row in all; the group's columns become the identity."""
    keys = [r.spelled(k) for k in by]
    _distinct_names([*keys, *made])
    out = [c.alias(k) for k, c in made.items()]
    if not out:
        df = r.df.select(*keys).distinct()
    else:
        df = r.df.groupBy(*keys).agg(*out) if keys else r.df.agg(*out)
    return r.with_(df, identity=tuple(keys), sort=())


WHOLE = {"sum": A.sum_, "mean": A.mean, "avg": A.mean, "min": F.min, "max": F.max, "count": A.count}
ORDERED = {"row_number", "rank", "dense_rank", "lag", "lead", "running_sum"}


def window(r: Relation, partition: tuple[str, ...] = (), order: tuple[str, ...] = (), /, **made: tuple) -> Relation:
    """``name=("lag", "col", 2)``: columns from neighbouring rows. Ties are ordered by every other column, but for the ranks."""
    part = [r.spelled(p) for p in partition]
    keys = [(r.spelled(k.lstrip("-")), k.startswith("-")) for k in order]
    base = Window.partitionBy(*part)
    total = base.orderBy(*order_by(keys, [c for c in r.columns if c not in part]))
    by_keys = base.orderBy(*order_by(keys))
    out: dict[str, Column] = {}
    for name, (fn, *args) in made.items():
        if fn in ORDERED and not keys:
            raise AnalysisError("L126", f"{fn} needs an order")
        if fn == "row_number":
            out[name] = F.row_number().over(total).cast("long")
        elif fn in ("rank", "dense_rank"):
            out[name] = getattr(F, fn)().over(by_keys).cast("long")
        elif fn in ("lag", "lead"):
            step = args[1] if len(args) > 1 else 1
            if step < 1:
                raise AnalysisError("L126", f"{fn} needs a step of 1 or more")
            out[name] = getattr(F, fn)(_column(args[0]), step).over(total)
        elif fn == "running_sum":
            out[name] = F.sum(_column(args[0])).over(total.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        elif fn in WHOLE:
            out[name] = (F.count("*") if fn == "count" and not args else F.avg(_column(args[0]).cast("double")) if fn in ("mean", "avg") else getattr(F, fn)(_column(args[0]))).over(base)
        else:
            raise AnalysisError("L126", f"{fn} is no window function")
    _distinct_names([*r.columns, *out])
    return r.with_(r.df.withColumns(out))


# joins


def _output(left: Relation, right: Relation, merged: dict[str, Column], l_alias: str, r_alias: str, keep_right_keys: bool) -> list[Column]:
    """Columns after a join: shared names are ``<input>_<column>``, with _2, _3 where that is taken."""
    low = [c.lower() for c in left.columns]
    shared = {c.lower() for c in right.columns} & set(low) - {k.lower() for k in merged}
    taken, out = {k.lower() for k in merged}, [c.alias(k) for k, c in merged.items()]
    plan = [(left, l_alias, c) for c in left.columns if c.lower() not in {k.lower() for k in merged}] + [(right, r_alias, c) for c in right.columns if keep_right_keys or c.lower() not in {k.lower() for k in merged}]
    taken |= {c.lower() for _, _, c in plan if c.lower() not in shared}
    for _, alias, c in plan:
        name = c
        if c.lower() in shared:
            name, i = f"{alias}_{c}", 2
            while name.lower() in taken:
                name, i = f"{alias}_{c}_{i}", i + 1
            taken.add(name.lower())
        out.append(F.col(f"`{alias}`.`{c}`").alias(name))
    return out


def join(r: Relation, other: Relation, on: tuple[str, ...] | Column | bool, how: str = "inner", alias: str | None = None) -> Relation:
    """inner, left, right or full join by shared columns (merged to one) or by a condition on ``left.name`` columns; ``on=True`` is a cross join.

    Null keys never match. The merged key is that of the side that has the row.
    """
    la, ra = r.name, alias or other.name
    if la.lower() == ra.lower():
        raise AnalysisError("L120", f"{ra} is joined to itself without an alias")
    left, right = r.df.alias(la), other.df.alias(ra)
    if on is True:
        df = left.crossJoin(right).select(*_output(r, other, {}, la, ra, True))
    elif isinstance(on, Column):
        df = left.join(right, on, how).select(*_output(r, other, {}, la, ra, True))
    else:
        keys = [(r.spelled(k), other.spelled(k)) for k in on]
        cond = None
        for a, b in keys:
            c = F.col(f"`{la}`.`{a}`") == F.col(f"`{ra}`.`{b}`")
            cond = c if cond is None else cond & c
        pick: Callable = {
            "right": lambda a, b: F.col(f"`{ra}`.`{b}`"),
            "full": lambda a, b: F.coalesce(F.col(f"`{la}`.`{a}`"), F.col(f"`{ra}`.`{b}`")),
        }.get(how, lambda a, b: F.col(f"`{la}`.`{a}`"))
        df = left.join(right, cond, how).select(*_output(r, other, {a: pick(a, b) for a, b in keys}, la, ra, False))
    return r.with_(df, identity=(), sort=())


def semi(r: Relation, other: Relation, on: tuple[str, ...], anti: bool = False) -> Relation:
    """Rows with (without) a partner."""
    return r.with_(r.df.join(other.df.select(*[F.col(other.spelled(k)).alias(r.spelled(k)) for k in on]).distinct(), [r.spelled(k) for k in on], "left_anti" if anti else "left_semi"))


def asof(r: Relation, other: Relation, equal: tuple[tuple[str, str], ...], probe: tuple[str, str, str], left: bool = False, alias: str | None = None) -> Relation:
    """The nearest row of ``other``: ``probe`` is (column, one of >= > <= <, column of other).

    Both sides are one stream, partitioned by the keys and ordered by time; the last (first) right row before (after) a left
    row is carried along in one window: one shuffle and one sort, and no join on the inequality. Right rows with a null key or time never match.
    The compared columns must cover an identity of ``other``, so that the nearest row is one.
    """
    column, op, target = r.spelled(probe[0]), probe[1], other.spelled(probe[2])
    if op not in (">=", ">", "<=", "<"):
        raise AnalysisError("L127", "an as-of join needs exactly one of >=, >, <=, <")
    if not other.identity or not {i.lower() for i in other.identity} <= {target.lower(), *(b.lower() for _, b in equal)}:
        raise AnalysisError("L128", f"the as-of condition doesn't cover an identity of {other.name}")
    la, ra = r.name, alias or other.name
    keys = [(r.spelled(a), other.spelled(b)) for a, b in equal]
    usable = other.df.filter(F.col(target).isNotNull())
    for _, b in keys:
        usable = usable.filter(F.col(b).isNotNull())
    kind = L.unify(r.type_of(column), other.type_of(target))
    empty = lambda df: F.lit(None).cast(df.schema)
    names = [f"k{i}" for i in range(len(keys))]
    stream = r.df.select(*[F.col(a).alias(n) for (a, _), n in zip(keys, names)], F.col(column).cast(kind).alias("t"), F.lit(True).alias("asks"), F.struct(*r.columns).alias("l"), empty(other.df).alias("o"))
    facts = usable.select(*[F.col(b).alias(n) for (_, b), n in zip(keys, names)], F.col(target).cast(kind).alias("t"), F.lit(False).alias("asks"), empty(r.df).alias("l"), F.struct(*other.columns).alias("o"))
    back = op in (">=", ">")
    # at equal times a fact stands before the question if it counts, else behind it
    at_once = F.col("asks") if op in (">=", "<=") else ~F.col("asks")
    w = Window.partitionBy(*names).orderBy(F.col("t").asc() if back else F.col("t").desc(), at_once.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = stream.unionByName(facts).withColumn("o", F.when(F.col("t").isNotNull(), F.last("o", ignorenulls=True).over(w)))
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    both = both.filter("asks").withColumn("o", F.when(known, F.col("o")))
    if not left:
        both = both.filter(F.col("o").isNotNull())
    flat = both.select(F.col("l"), F.col("o"))
    shared = {c.lower() for c in r.columns} & {c.lower() for c in other.columns}
    out = [F.col(f"l.`{c}`").alias(f"{la}_{c}" if c.lower() in shared else c) for c in r.columns] + [F.col(f"o.`{c}`").alias(f"{ra}_{c}" if c.lower() in shared else c) for c in other.columns]
    ident = tuple(f"{la}_{i}" if i.lower() in shared else i for i in r.identity)
    return r.with_(flat.select(*out), identity=ident, sort=())


def native_sql(spark, query: str, **inputs: Relation) -> Relation:
    """A relation from Spark SQL over the named inputs (``{name}`` in the text)."""
    return Relation(spark.sql(query, **{k: v.df for k, v in inputs.items()}), name="native")
