"""Aggregates of the language. Each takes a column and its type, and returns the column with the language's result type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sum_(x: Column, t: T.DataType | None = None) -> Column:
    """Null without a value; decimals keep their scale, integers stay integers and fail on overflow."""
    if isinstance(t, T.DecimalType):
        return F.sum(x).cast(T.DecimalType(38, t.scale))
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return F.sum(x.cast("long"))
    return F.sum(x)


def mean(x: Column) -> Column:
    """Always a float, decimals too."""
    return F.avg(x.cast("double"))


def missing(x: Column, t: T.DataType | None = None) -> Column:
    """The share of rows in which x is null or blank text."""
    gone = x.isNull()
    if t is None or isinstance(t, T.StringType):
        gone = gone | F.coalesce(F.trim(x.cast("string")) == "", F.lit(False))
    return F.avg(F.when(gone, 1.0).otherwise(0.0))


def count(x: Column | None = None) -> Column:
    return F.count("*") if x is None else F.count(x)


def count_distinct(x: Column) -> Column:
    return F.countDistinct(x)


def any_(b: Column) -> Column:
    return F.bool_or(b)


def all_(b: Column) -> Column:
    return F.bool_and(b)


REGISTRY = {"sum": sum_, "mean": mean, "avg": mean, "min": F.min, "max": F.max, "count": count, "count_distinct": count_distinct, "missing": missing, "any": any_, "all": all_}
