"""The language's types, how they unify, and how arithmetic types results."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ledgerloom.errors import AnalysisError

INT, FLOAT, STRING, BOOL, DATE = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType()
TIMESTAMP, TIMESTAMP_TZ, BINARY = T.TimestampNTZType(), T.TimestampType(), T.BinaryType()

#: Type names of a source contract; times and JSON are validated text.
NAMES = {
    "bool": BOOL, "boolean": BOOL, "int": INT, "integer": INT, "decimal": T.DecimalType(18, 3), "float": FLOAT, "double": FLOAT, "string": STRING, "text": STRING,
    "date": DATE, "time": STRING, "timestamp": TIMESTAMP, "timestamp_tz": TIMESTAMP_TZ, "binary": BINARY, "json": STRING,
}


def parse_type(name: str) -> T.DataType:
    """``decimal(18,2)`` and the like."""
    m = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name.strip().lower())
    if m:
        p, s = int(m[1]), int(m[2])
        if not 1 <= p <= 38 or s > p:
            raise AnalysisError("L101", f"decimal({p},{s}) is out of range")
        return T.DecimalType(p, s)
    if name.strip().lower() not in NAMES:
        raise AnalysisError("L101", f"unknown type {name}")
    return NAMES[name.strip().lower()]


def language_type(t: T.DataType) -> T.DataType:
    """Every integer is 64 bits wide, every binary fraction a double."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return INT
    return FLOAT if isinstance(t, T.FloatType) else t


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.DoubleType, T.DecimalType))


def _digits(t: T.DataType) -> tuple[int, int]:
    return (18, 0) if isinstance(t, T.LongType) else (t.precision - t.scale, t.scale)


def unify(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a column that holds values of both, as in union, coalesce and case."""
    a, b = language_type(a), language_type(b)
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if is_numeric(a) and is_numeric(b):
        if FLOAT in (a, b):
            return FLOAT
        (ia, sa), (ib, sb) = _digits(a), _digits(b)
        scale = max(sa, sb)
        return T.DecimalType(min(38, max(ia, ib) + scale), scale)
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return TIMESTAMP
    raise AnalysisError("L102", f"{a.simpleString()} and {b.simpleString()} don't go together")


def arithmetic(op: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of ``a op b`` for numbers; a quotient is always a float."""
    a, b = language_type(a), language_type(b)
    if not is_numeric(a) or not is_numeric(b):
        raise AnalysisError("L102", f"{op} needs numbers, not {a.simpleString()} and {b.simpleString()}")
    if op == "/" or FLOAT in (a, b):
        return FLOAT
    if a == b == INT:
        return INT
    (ia, sa), (ib, sb) = _digits(a), _digits(b)
    if op == "*":
        return T.DecimalType(min(38, ia + ib + sa + sb), min(38, sa + sb))
    scale = max(sa, sb)
    return T.DecimalType(min(38, max(ia, ib) + scale + (op in "+-")), scale)
