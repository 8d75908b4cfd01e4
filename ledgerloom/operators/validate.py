"""Checks on a relation: require, expect and warn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.errors import RunError
from ledgerloom.relation import Relation

CHECKS = "check string, severity string, status string, failing_rows long, total_rows long, measured string"


@dataclass(frozen=True)
class Check:
    """kind row: ``value`` is a condition on a row, null passes. not_null and unique: ``value`` names columns.
    whole: ``value`` is a condition on ``measured``, an aggregate of all rows; null fails."""

    name: str
    severity: str
    kind: str
    value: Column | tuple[str, ...]
    measured: Column | None = None


def row(name: str, condition: Column, severity: str = "require") -> Check:
    return Check(name, severity, "row", condition)


def not_null(column: str, severity: str = "require") -> Check:
    return Check(f"{column} not null", severity, "not_null", (column,))


def unique(*columns: str, severity: str = "require") -> Check:
    return Check(f"unique({', '.join(columns)})", severity, "unique", columns)


def whole(name: str, measured: Column, condition, severity: str = "require") -> Check:
    """``condition`` takes the measured column."""
    return Check(name, severity, "whole", condition(F.col("m")), measured)


def _failing(check: Check) -> Column:
    if check.kind == "row":
        return ~F.coalesce(check.value, F.lit(True))
    if check.kind == "not_null":
        return F.col(check.value[0]).isNull()
    return F.count("*").over(Window.partitionBy(*check.value)) > 1  # null keys are equal here


def failures(r: Relation, checks: list[Check], rows: DataFrame | None = None) -> DataFrame:
    """check, severity and the columns of the failing rows (clashing ones are row_...); ``rows`` is a source's relation with source_row."""
    names = [f"row_{c}" if c.lower() in ("check", "severity", "source_row") else c for c in r.columns]
    if rows is not None:
        r, names = r.with_(rows), [*names, "source_row"]
    out = None
    for c in checks:
        if c.kind == "whole":
            continue
        part = r.df.withColumn("_bad", _failing(c)).filter("_bad").drop("_bad").toDF(*names).select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), *names)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = r.df.limit(0).toDF(*names).select(F.lit("").alias("check"), F.lit("").alias("severity"), *names)
    return out


def results(r: Relation, checks: list[Check]) -> DataFrame:
    """One row for each check. Row, presence and whole-relation checks share one pass; each uniqueness check is one aggregation."""
    shared = [c for c in checks if c.kind != "unique"]
    cols = [F.count("*").alias("n")]
    for i, c in enumerate(shared):
        if c.kind == "whole":
            cols.append(c.measured.alias(f"m{i}"))
        else:
            cols.append(F.count_if(_failing(c)).alias(f"f{i}"))
    text = lambda v: F.lit(v).cast("string")
    made = []
    for i, c in enumerate(shared):
        if c.kind == "whole":
            status, failing, measured = F.when(F.coalesce(F.col(f"good{i}"), F.lit(False)), "pass").otherwise("fail"), F.lit(None).cast("long"), F.col(f"m{i}").cast("string")
        else:
            status, failing, measured = F.when(F.col(f"f{i}") == 0, "pass").otherwise("fail"), F.col(f"f{i}"), text(None)
        made.append(F.struct(text(c.name).alias("check"), text(c.severity).alias("severity"), status.alias("status"), failing.alias("failing_rows"), F.col("n").alias("total_rows"), measured.alias("measured")))
    one = r.df.agg(*cols)
    for i, c in enumerate(shared):
        if c.kind == "whole":  # its condition reads the measured value as m
            one = one.withColumn("m", F.col(f"m{i}")).withColumn(f"good{i}", c.value)
    rows = one.select(F.inline(F.array(*made))) if made else None
    for c in (c for c in checks if c.kind == "unique"):
        groups = r.df.groupBy(*c.value).agg(F.count("*").alias("k"))
        part = groups.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("failing_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("total_rows"))
        part = part.select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.when(F.col("failing_rows") == 0, "pass").otherwise("fail").alias("status"), "failing_rows", "total_rows", F.lit(None).cast("string").alias("measured"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def enforce(r: Relation, checks: list[Check], keep_going: bool = False) -> list[dict]:
    """Run the checks. A failed require stops unless ``keep_going``; messages hold no values. Returns the rows of results()."""
    found = [x.asDict() for x in results(r, checks).collect()]
    bad = [x["check"] for x in found if x["status"] == "fail" and x["severity"] == "require"]
    if bad and not keep_going:
        raise RunError("L402", f"{r.name}: {len(bad)} required checks failed: {'; '.join(bad)}")
    return found
