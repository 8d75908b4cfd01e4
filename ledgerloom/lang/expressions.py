"""Expressions of the language as Columns, with the language's types."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import types as L
from ledgerloom.errors import AnalysisError
from ledgerloom.functions import aggregate as A
from ledgerloom.functions import scalar as S

AGGREGATES = set(A.REGISTRY)


def has_aggregate(e) -> bool:
    """Whether a tree calls an aggregate."""
    if isinstance(e, tuple):
        return (e[:1] == ("call",) and e[1].lower() in AGGREGATES) or any(has_aggregate(x) for x in e)
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def columns_of(e) -> list[str]:
    if isinstance(e, tuple):
        return [e[1]] if e[:1] == ("col",) else [c for x in e for c in columns_of(x)]
    return [c for x in e for c in columns_of(x)] if isinstance(e, list) else []


#: What a function's first arguments are: s text, n a number, i a whole number, t a date or timestamp, b true or false.
ARGUMENTS = {
    "lower": "s", "upper": "s", "trim": "s", "strip_accents": "s", "replace": "sss", "contains": "ss", "starts_with": "ss", "ends_with": "ss", "length": "s", "substr": "sii",
    "regexp_matches": "ss", "abs": "n", "floor": "n", "ceil": "n", "parse_number": "s", "year": "t", "month": "t", "day": "t", "quarter": "t", "day_of_week": "t",
    "days_between": "tt", "date_diff": "tt", "similarity": "ss", "token_similarity": "ss", "levenshtein": "ss", "if": "b",
}
_KINDS = {"s": T.StringType, "n": T.NumericType, "i": T.IntegralType, "t": (T.DateType, T.TimestampType, T.TimestampNTZType), "b": T.BooleanType}


class Compiler:
    """``resolve`` gives the Column of a (dotted) name; ``frame`` is a DataFrame on which types are found."""

    def __init__(self, frame: DataFrame, resolve: Callable[[str], Column], mappings: dict, today=None):
        self.frame, self.resolve, self.mappings, self.today = frame, resolve, mappings, today

    def type(self, c: Column) -> T.DataType:
        return L.language_type(self.frame.select(c.alias("x")).schema[0].dataType)

    def kind(self, c: Column) -> str:
        t = self.type(c)
        return "int" if t == L.INT else "float" if t == L.FLOAT else "decimal" if isinstance(t, T.DecimalType) else "date" if isinstance(t, T.DateType) else t.simpleString()

    def __call__(self, e: tuple) -> Column:
        return getattr(self, f"e_{e[0]}")(*e[1:])

    def e_lit(self, v):
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    def e_col(self, name):
        return self.resolve(name)

    def e_and(self, a, b):
        return self(a) & self(b)

    def e_or(self, a, b):
        return self(a) | self(b)

    def e_not(self, a):
        return ~self(a)

    def e_isnull(self, a):
        return self(a).isNull()

    def e_in(self, a, items):
        return self(a).isin(*[self(x) for x in items])

    def e_neg(self, a):
        return -self(a)

    def e_cmp(self, op, a, b):
        x, y = self(a), self(b)
        tx, ty = self.type(x), self.type(y)
        if not (L.is_numeric(tx) and L.is_numeric(ty)):
            L.unify(tx, ty)
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def e_arith(self, op, a, b):
        x, y = self(a), self(b)
        tx, ty = self.type(x), self.type(y)
        if isinstance(tx, T.DateType) and op in "+-":
            if ty == L.INT:
                return F.date_add(x, (y if op == "+" else -y).cast("int"))
            if isinstance(ty, T.DateType) and op == "-":
                return F.datediff(x, y).cast("long")
        want = L.arithmetic(op, tx, ty)
        if op == "/":
            return S.divide(x, y)
        if op == "%":
            return S.modulo(x, y)
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
        return out.cast(want) if isinstance(want, T.DecimalType) else out

    def e_case(self, arms, rest):
        return reduce(lambda acc, a: (F.when if acc is None else acc.when)(self(a[0]), self(a[1])), arms, None).otherwise(self(rest))

    def literal(self, e):
        if e[0] == "neg":
            return -self.literal(e[1])
        if e[0] != "lit":
            raise AnalysisError("L108", "this argument must be a literal")
        return e[1]

    def mapping(self, e) -> tuple[dict, object]:
        if e[0] != "col" or e[1].lower() not in self.mappings:
            raise AnalysisError("L002", "no such mapping")
        return self.mappings[e[1].lower()]

    def apply_mapping(self, x: Column, arms: list, rest: tuple) -> Column:
        plain = lambda v: v if not isinstance(v, Decimal) else v
        return S.mapped(x, {tuple(map(plain, k)): v for k, v in arms}, x if rest == ("original",) else F.lit(None) if rest == ("null",) else self(rest))

    def e_call(self, name, args):
        fn = name.lower()
        if fn.startswith("duckdb.") or fn.startswith("spark."):
            return S.native(name.split(".", 1)[1], *[self(a) for a in args])
        if fn in AGGREGATES:
            return self.aggregate(fn, args)
        if fn == "map":
            return self.apply_mapping(self(args[0]), *self.mapping(args[1]))
        if fn == "replace_words":
            arms, _ = self.mapping(args[1])
            return S.replace_words(self(args[0]), dict(arms))
        if fn in ("regexp_replace", "regexp_extract", "to_decimal", "parse_date", "parse_timestamp"):
            return S.REGISTRY[fn](self(args[0]), *[self.literal(a) for a in args[1:]])
        if fn == "date" and len(args) == 1:
            return F.lit(self.literal(args[0])).cast("date") if args[0][0] == "lit" and isinstance(args[0][1], str) else S.to_date(self(args[0]))
        if fn == "today":
            return S.today(self.today)
        if fn in ("lpad", "rpad"):
            return S.REGISTRY[fn](self(args[0]), self(args[1]).cast("int"), self(args[2]))
        xs = [self(a) for a in args]
        if fn in ("coalesce", "if", "least", "greatest") and len(xs) > 1:
            values = xs[1:] if fn == "if" else xs
            kind = reduce(L.unify, [self.type(v) for v in values])
            cast = [v.cast(kind) if not isinstance(kind, T.NullType) else v for v in values]
            xs = [xs[0], *cast] if fn == "if" else cast
        if fn in ("floor", "ceil"):
            return S.REGISTRY[fn](xs[0], self.kind(xs[0]))
        if fn == "round":
            digits = self.literal(args[1]) if len(args) > 1 else 0
            return xs[0] if self.kind(xs[0]) == "int" and digits >= 0 else F.round(xs[0], digits)
        if fn == "add_days":
            return S.add_days(xs[0], xs[1], self.kind(xs[0]))
        if fn not in S.REGISTRY:
            raise AnalysisError("L107", f"no function {name}")
        self.check_arguments(fn, xs)
        return S.REGISTRY[fn](*xs)

    def check_arguments(self, fn: str, xs: list[Column]) -> None:
        """Arguments whose type a function doesn't take are an error before anything runs."""
        wanted = ARGUMENTS.get(fn, "")
        for i, (x, w) in enumerate(zip(xs, wanted), 1):
            kind = self.type(x)
            if not isinstance(kind, T.NullType) and not isinstance(kind, _KINDS[w]):
                raise AnalysisError("L102", f"argument {i} of {fn} is {kind.simpleString()}")

    def aggregate(self, fn: str, args: list) -> Column:
        if any(has_aggregate(a) for a in args):
            raise AnalysisError("L110", "an aggregate inside an aggregate")
        if fn == "count":
            return F.count("*") if not args else F.count(self(args[0]))
        x = self(args[0])
        return A.REGISTRY[fn](x, self.type(x)) if fn in ("sum", "missing") else A.REGISTRY[fn](x)
