"""Queries for source contracts on columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.sources import contract as K

_DECLARED = [K.Declared("event_id", "int"), K.Declared("kind", "int", True), K.Declared("amount", "decimal(12,2)", True), K.Declared("day", "date", True, ("%d/%m/%Y",)), K.Declared("yes", "bool", True)]


def _raw(spark, d) -> DataFrame:
    """Events as text, as a file would hold them."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), (F.col("event_id") % 10).cast("string"))).alias("kind"),
        F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(F.col("event_id") % 5 == 0, F.lit("31/02/2024")).otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("day"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("F").alias("yes"),
    )


@query("source_typed", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 10 END AS kind, CASE WHEN event_id % 4 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(12,2)) END AS amount,
       CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS day, event_id % 2 = 0 AS yes FROM events
""")
def source_typed(spark, d) -> DataFrame:
    return K.typed(_raw(spark, d), _DECLARED, row="n", identity=("event_id",), name="events").relation.df


@query("source_rejects", """
SELECT event_id AS row, 'kind' AS "column", 'int' AS expected, event_type AS value FROM events WHERE event_id % 3 = 0 AND event_type IS NOT NULL
UNION ALL SELECT event_id, 'day', 'date', '31/02/2024' FROM events WHERE event_id % 5 = 0
""")
def source_rejects(spark, d) -> DataFrame:
    return K.typed(_raw(spark, d), _DECLARED, row="n", identity=("event_id",), name="events").rejects


@query("source_inference", """
SELECT 'event_id' AS name, 'int' AS type UNION ALL SELECT 'kind', 'string' UNION ALL SELECT 'amount', 'decimal(18,2)' UNION ALL SELECT 'day', 'string' UNION ALL SELECT 'yes', 'bool'
""")
def source_inference(spark, d) -> DataFrame:
    raw = _raw(spark, d)
    return spark.createDataFrame([(x.name, x.type) for x in K.infer(raw, skip=("n",))], "name string, type string")
