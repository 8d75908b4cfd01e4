"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir: they cut lineage and outlive executors."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import RunError


class Scratch:
    """Tables below one folder. Without the setting, only a session on one machine gets a folder: /tmp is no cluster's shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RunError("L200", "spark.checkpoint.dir names no shared folder")
            base = "/tmp/ledgerloom-scratch"
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write and read again."""
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")


@contextmanager
def by_real_sizes(spark: SparkSession):
    """Within, what is joined is broadcast by the size that it turns out to have. Planned sizes are those of compressed files: a few MB of
    scratch tables can be millions of rows, which the driver would gather."""
    planned, real = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (planned, real)}
    spark.conf.set(real, before[real] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(scratch: Scratch, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with numbers from 1 in the given order (df's own, if it is empty), without moving all rows to one task: rows are numbered in their
    sorted partition, of which only the sizes are gathered."""
    at = (F.shiftright(F.col(name), 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
    kept = scratch.keep((df.orderBy(*order) if order else df).withColumn(name, F.monotonically_increasing_id()))
    sizes = {r["part"]: r["n"] for r in kept.groupBy(at[0].cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    start = F.get(F.array(*map(F.lit, offsets)), at[0].cast("int")) if offsets else F.lit(0)
    return kept.withColumn(name, (start + at[1] + 1).cast("long"))


def numbered_in_files(scratch: Scratch, df: DataFrame, file: str, block: str, name: str) -> DataFrame:
    """df, as it was read, with numbers from 1 in the order of files' names and places in them, instead of the columns ``file`` and ``block``
    (where the split of the file begins). Splits of several files are one task's work in any order; only their sizes are gathered."""
    kept = scratch.keep(df.withColumn(name, F.monotonically_increasing_id()))
    before, shifts = 0, []
    for r in sorted(kept.groupBy(file, block).agg(F.min(name).alias("first"), F.count("*").alias("n")).collect(), key=lambda r: (r[file], r[block])):
        shifts.append((r[file], r[block], before + 1 - r["first"]))
        before += r["n"]
    shift = scratch.spark.createDataFrame(shifts, f"`{file}` string, `{block}` long, _shift long")
    return kept.join(F.broadcast(shift), [file, block]).withColumn(name, F.col(name) + F.col("_shift")).drop(file, block, "_shift")
