"""What changed in the data: unknown enum values, stale loads, schemas."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More distinct values than this are no enumeration.
ENUM_LIMIT = 50


def unknown_values(df: DataFrame, column: str, known: list[str], limit: int = ENUM_LIMIT) -> DataFrame:
    """(value): live values that the model doesn't name; none if there are more than ``limit`` live values."""
    live = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().limit(limit + 1)
    named = df.sparkSession.createDataFrame([(v,) for v in known], "value string")
    few = live.agg(F.count("*").alias("_n"))
    return live.join(F.broadcast(named), "value", "left_anti").join(F.broadcast(few)).where(F.col("_n") <= limit).select("value")


def stale(df: DataFrame, column: str, cadence: str, today: date) -> DataFrame:
    """One row (last_date, days_behind, is_stale) by how often the table is loaded."""
    allowed = {"daily": 2, "weekly": 14}.get(cadence, 90)
    out = df.agg(F.to_date(F.max(column)).alias("last_date"))
    return out.withColumn("days_behind", F.datediff(F.lit(today), "last_date")).withColumn("is_stale", F.coalesce(F.col("days_behind") > allowed, F.lit(True)))


def schema_rows(spark, tables) -> DataFrame:
    rows = [(t.qualified, c, kind) for t in tables for c, kind in t.rendered().items()]
    return spark.createDataFrame(rows, "table string, column string, sql_type string")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, table, column, detail): tables and columns added, dropped or retyped."""
    keys = ["table", "column"]
    tables = before.select("table").distinct().withColumn("_was", F.lit(True)).join(after.select("table").distinct().withColumn("_is", F.lit(True)), "table", "full_outer")
    gone = tables.where("_was is null or _is is null").select(F.when(F.col("_is").isNull(), "table_dropped").otherwise("table_added").alias("kind"), "table", F.lit(None).cast("string").alias("column"), F.lit("").alias("detail"))
    both = before.withColumnRenamed("sql_type", "old").join(after.withColumnRenamed("sql_type", "new"), keys, "full_outer").join(gone.select("table"), "table", "left_anti").where("not old <=> new")
    kind = F.when(F.col("new").isNull(), "column_dropped").when(F.col("old").isNull(), "column_added").otherwise("column_retyped")
    detail = F.concat_ws(" -> ", "old", "new")
    return gone.unionByName(both.select(kind.alias("kind"), "table", "column", detail.alias("detail"))).orderBy("table", "column", "kind")
