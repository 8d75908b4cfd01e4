"""Source contracts: text becomes typed columns without loss, or the value is listed as rejected.

``typed()`` gives the typed relation and the rejects of a text table in plain column expressions, so both scale with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import RunError
from ledgerloom.functions.scalar import java_format
from ledgerloom.relation import Relation
from ledgerloom.types import parse_type

#: Unicode white space around values, for Java's regular expressions.
_SPACE = r"[\s\u000B\u0085\p{Z}]"
_TRUE, _FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


@dataclass(frozen=True)
class Declared:
    """``type`` as in the language (``decimal(18,2)``); ``formats``: date formats tried before ISO."""

    name: str
    type: str
    nullable: bool = False
    formats: tuple[str, ...] = ()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """Text of white space only is null, other text stays as it is."""
    return F.when(trimmed(c) != "", c)


def exact(c: Column, d: Declared) -> Column:
    """The typed value, null if the text isn't exactly one: nothing is rounded or cut."""
    t = trimmed(c)
    kind = d.type.strip().lower()
    if kind in ("string", "text"):
        return c
    if kind in ("bool", "boolean"):
        low = F.lower(t)
        return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)
    if kind in ("int", "integer"):
        return F.when(t.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("bigint"))
    if kind.startswith("decimal"):
        return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast(parse_type(d.type)))
    if kind in ("float", "double"):
        return t.try_cast("double")
    if kind == "date":
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0*)?)?)?$"), F.substring(t, 1, 10).try_cast("date"))
        own = [F.try_to_timestamp(t, F.lit(java_format(f))) for f in d.formats]
        return F.coalesce(*[F.when(x == F.date_trunc("day", x), x.cast("date")) for x in own], iso)
    if kind == "time":
        return F.when(t.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"), t)
    if kind == "timestamp":
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), t.try_cast("timestamp_ntz"))
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(java_format(f))).cast("timestamp_ntz") for f in d.formats], iso)
    if kind == "timestamp_tz":
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(java_format(f))) for f in d.formats], t.try_cast("timestamp"))
    if kind == "binary":
        return c.cast("binary")
    if kind == "json":
        return F.when(F.try_parse_json(c).isNotNull(), c)
    return t.try_cast(parse_type(d.type))


def exact_native(c: Column, have: T.DataType, d: Declared) -> Column:
    """As exact(), for a column that is typed already: whole numbers only become int, midnights only become dates."""
    if isinstance(have, T.StringType):
        return exact(c, d)
    want = parse_type(d.type)
    if isinstance(want, T.LongType) and isinstance(have, (T.DecimalType, T.DoubleType, T.FloatType)):
        return F.when(F.floor(c) == c, c.try_cast("bigint"))
    if isinstance(want, T.DateType) and isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c == F.date_trunc("day", c), c.cast("date"))
    return c.try_cast(want)


def fill_down(df: DataFrame, columns: list[str], row: str, group: str | None = None) -> DataFrame:
    """A blank takes the nearest value above it; ``row`` orders the rows, of each ``group`` (such as a file) alone if given.

    Without a group the order is total, which needs one task; the rows before are reduced to their last value per range
    of ``row`` first, so that only one row for each range meets there.
    """
    value = {c: blank_to_null(F.col(c)) for c in columns}
    if group:
        w = Window.partitionBy(group).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in value.items()})
    span = 100_000
    cut = df.withColumns(value).withColumn("_g", F.floor(F.col(row) / span).cast("long"))
    inside = Window.partitionBy("_g").orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tails = cut.groupBy("_g").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row))).alias(c) for c in columns])
    tails = tails.select("_g", *[F.last(c, ignorenulls=True).over(before).alias(f"_b_{c}") for c in columns])
    out = cut.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).join(tails, "_g", "left")
    return out.withColumns({c: F.coalesce(c, f"_b_{c}") for c in columns}).select(*df.columns)


@dataclass(frozen=True)
class Source:
    relation: Relation
    rejects: DataFrame
    rounded: DataFrame
    rows: DataFrame | None = None


def typed(raw: DataFrame, declared: list[Declared], row: str | None = None, identity: tuple[str, ...] = (), name: str = "source", keep_row: bool = False) -> Source:
    """The typed relation, ``rejects`` (row, column, expected, value) ``rounded`` (column, values that the declared scale changed) and, if rows have
    numbers, ``rows``: the relation with source_row."""
    kinds = {f.name.lower(): f.dataType for f in raw.schema}
    missing = [d.name for d in declared if d.name.lower() not in kinds]
    if missing:
        raise RunError("L202", f"{name} lacks the declared columns {', '.join(missing)}")
    text = {d.name: blank_to_null(F.col(f"`{d.name}`")) if isinstance(kinds[d.name.lower()], T.StringType) else F.col(f"`{d.name}`") for d in declared}
    value = {d.name: exact_native(text[d.name], kinds[d.name.lower()], d) for d in declared}
    at = [F.col(row)] if row else []
    table = raw.select(*[v.alias(d.name) for d, v in zip(declared, value.values())], *([F.col(row)] if row and keep_row else []))
    bad = [
        F.when(text[d.name].isNotNull() & value[d.name].isNull(), F.struct((at[0] if at else F.lit(None)).cast("long").alias("row"), F.lit(d.name).alias("column"), F.lit(d.type).alias("expected"), text[d.name].cast("string").alias("value")))
        for d in declared
    ]
    rejects = raw.select(F.explode(F.array_compact(F.array(*bad))).alias("x")).select("x.*")
    cut = [F.count_if(text[d.name].try_cast("decimal(38,15)") != value[d.name]).alias(d.name) for d in declared if d.type.lower().startswith("decimal")]
    rounded = raw.agg(*cut).unpivot([], [d.name for d in declared if d.type.lower().startswith("decimal")], "column", "rows").filter("rows > 0") if cut else raw.sparkSession.createDataFrame([], "column string, rows long")
    free = row and "source_row" not in {c.lower() for c in table.columns}
    rows = raw.select(*[v.alias(d.name) for d, v in zip(declared, value.values())], *([F.col(row)] if keep_row else []), F.col(row).cast("long").alias("source_row")) if free else None
    return Source(Relation(table, name=name, identity=identity), rejects, rounded, rows)


def enforce(source: Source, declared: list[Declared]) -> None:
    """Stop if a declared non-null column has nulls or the identity repeats."""
    r = source.relation
    must = [d.name for d in declared if not d.nullable]
    nulls = r.df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in must]).first() if must else None
    if nulls is not None and (bad := [c for c in must if nulls[c]]):
        raise RunError("L210", f"{r.name}: declared non-null columns have nulls: {', '.join(bad)}")
    if r.identity:
        cond = F.lit(False)
        for i in r.identity:
            cond = cond | F.col(i).isNull()
        if not r.df.filter(cond).isEmpty() or not r.df.groupBy(*r.identity).count().filter("count > 1").isEmpty():
            raise RunError("L211", f"{r.name}: the identity is missing or repeats")


def infer(raw: DataFrame, skip: tuple[str, ...] = ()) -> list[Declared]:
    """The type that all values of each text column share, from one aggregation over every value."""
    names = [f.name for f in raw.schema if f.name not in skip]
    tests = {
        "int": r"^(0|[+-]?[1-9]\d{0,18}|-0)$", "decimal": r"^[+-]?(0|[1-9]\d*)?(\.\d+)?$", "float": r"^([+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?|nan|[+-]?inf(inity)?)$",
        "bool": r"^(true|false|t|f|yes|no|y|n)$", "time": r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$",
    }
    cols = []
    for i, n in enumerate(names):
        t = F.lower(trimmed(blank_to_null(F.col(f"`{n}`"))))
        cols.append(F.count(t).alias(f"n{i}"))
        cols += [F.count_if(t.rlike(p)).alias(f"{k}{i}") for k, p in tests.items()]
        cols.append(F.count_if(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull()).alias(f"date{i}"))
        cols.append(F.count_if(exact(F.upper(t), Declared(n, "timestamp")).isNotNull()).alias(f"timestamp{i}"))
        cols.append(F.max(F.length(F.regexp_extract(t, r"\.(\d+)$", 1))).alias(f"scale{i}"))
        cols.append(F.max(F.length(F.regexp_extract(t, r"^[+-]?(\d+)", 1))).alias(f"digits{i}"))
        cols.append(F.count_if(F.abs(t.try_cast("decimal(38,0)")) > (1 << 63) - 1).alias(f"wide{i}"))
    got = raw.agg(*cols).first()
    out = []
    for i, n in enumerate(names):
        every = lambda k, i=i: got[f"n{i}"] > 0 and got[f"{k}{i}"] == got[f"n{i}"]
        kind = "string"
        if every("int") and not got[f"wide{i}"]:
            kind = "int"
        elif every("decimal") and got[f"scale{i}"]:
            s = got[f"scale{i}"]
            kind = f"decimal({18 if got[f'digits{i}'] + s <= 18 else 38},{s})" if got[f"digits{i}"] + s <= 38 else "string"
        elif every("float") and not every("decimal"):
            kind = "float"
        elif every("bool"):
            kind = "bool"
        elif every("date"):
            kind = "date"
        elif every("timestamp"):
            kind = "timestamp"
        elif every("time"):
            kind = "time"
        out.append(Declared(n, kind, True))
    return out
