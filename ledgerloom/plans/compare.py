"""Comparing and describing relations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.relation import Relation


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def diff(a: Relation, b: Relation) -> DataFrame:
    """change ('added' in b, 'removed' from a), the common columns as text, and rows: how many; a multiset comparison in one aggregation."""
    common = [c for c in a.columns if b.has(c)]
    left = as_text(a.df, common).withColumn("_w", F.lit(-1))
    right = as_text(b.df.select(*[F.col(b.spelled(c)).alias(c) for c in common]), common).withColumn("_w", F.lit(1))
    both = left.unionByName(right).groupBy(*common).agg(F.sum("_w").alias("_n")).filter("_n <> 0")
    return both.select(F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), *common, F.abs("_n").alias("rows"))


def columns_changed(a: Relation, b: Relation) -> dict[str, list[str]]:
    return {"added": [c for c in b.columns if not a.has(c)], "removed": [c for c in a.columns if not b.has(c)]}


def same(a: Relation, b: Relation) -> bool:
    return not any(columns_changed(a, b).values()) and diff(a, b).isEmpty()


def profile(r: Relation) -> DataFrame:
    """column, type, rows, nulls, distinct_values, min, max, sum of each column. One aggregation has all but the distinct values; these are
    counted column by column, as together every row would be there once for each column with all of them."""
    cols = [F.count("*").alias("n")]
    for i, f in enumerate(r.df.schema):
        c = F.col(f"`{f.name}`")
        exact = isinstance(f.dataType, (T.IntegralType, T.DecimalType))
        cols += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}"), (F.sum(c.cast("decimal(38,6)") if isinstance(f.dataType, T.DecimalType) else c) if exact else F.lit(None)).cast("string").alias(f"sum{i}")]
    one = r.df.agg(*cols)
    for i, f in enumerate(r.df.schema):
        values = r.df.select(F.col(f"`{f.name}`").alias("v")).filter("v is not null")
        one = one.crossJoin(values.distinct().agg(F.count("*").alias(f"distinct{i}")))
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"distinct{i}").alias("distinct_values"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"sum{i}").alias("sum"))
        for i, f in enumerate(r.df.schema)
    ]
    return one.select(F.inline(F.array(*rows)))


def snapshot(spark: SparkSession, path: str, relations: dict[str, Relation], program: str = "") -> None:
    """Every relation as Parquet under ``path``, and a manifest with the program's digest, schemas and row counts."""
    meta = {"program_md5": hashlib.md5(program.encode()).hexdigest(), "relations": {}}
    for name, r in relations.items():
        r.df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta["relations"][name] = {"columns": [[f.name, f.dataType.simpleString()] for f in r.df.schema], "identity": list(r.identity), "rows": spark.read.parquet(f"{path}/{name}").count()}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def open_snapshot(spark: SparkSession, path: str) -> dict[str, Relation]:
    meta = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {n: Relation(spark.read.parquet(f"{path}/{n}"), name=n, identity=tuple(m["identity"])) for n, m in meta["relations"].items()}


def diff_snapshots(spark: SparkSession, a: str, b: str) -> dict[str, dict]:
    """For each relation: whether it is in one snapshot only, changed columns, and the counts of added and removed rows."""
    left, right = open_snapshot(spark, a), open_snapshot(spark, b)
    out: dict[str, dict] = {}
    for name in sorted({*left, *right}):
        if name not in left or name not in right:
            out[name] = {"only_in": "second" if name in right else "first"}
            continue
        counts = {r["change"]: r["n"] for r in diff(left[name], right[name]).groupBy("change").agg(F.sum("rows").alias("n")).collect()}
        out[name] = {"columns": columns_changed(left[name], right[name]), "added": counts.get("added", 0), "removed": counts.get("removed", 0)}
    return out
