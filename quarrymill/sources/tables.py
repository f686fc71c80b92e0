"""Where tables come from: a folder of Parquet, a catalog database, or DataFrames at hand."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import render


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[tuple[str, T.DataType], ...]

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def rendered(self) -> dict[str, str]:
        return {c: render(kind) for c, kind in self.columns}


class Source(Protocol):
    def tables(self) -> list[Table]: ...

    def df(self, name: str) -> DataFrame: ...


def _of(schema: str, name: str, kinds: T.StructType) -> Table:
    return Table(schema, name, tuple((f.name, f.dataType) for f in kinds))


class ParquetDir:
    """Every ``<name>.parquet`` file or folder below ``path``, listed with Hadoop's file system: any store will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def tables(self) -> list[Table]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top)
        names = sorted(s.getPath().getName().removesuffix(".parquet") for s in found if s.getPath().getName().endswith(".parquet"))
        return [_of("", n, self.df(n).schema) for n in names]

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


class Catalog:
    """The tables of one database, or of all, in the session's catalog (Iceberg and others included)."""

    INTERNAL = ("information_schema", "pg_catalog", "sys", "global_temp")

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, database

    def tables(self) -> list[Table]:
        bases = [self.database] if self.database else [d.name for d in self.spark.catalog.listDatabases()]
        found = [(b, t.name) for b in bases if b.lower() not in self.INTERNAL for t in self.spark.catalog.listTables(b)]
        return [_of(b, n, self.spark.table(f"`{b}`.`{n}`").schema) for b, n in sorted(found)]

    def df(self, name: str) -> DataFrame:
        parts = ([self.database] if self.database and "." not in name else []) + name.split(".")
        return self.spark.table(".".join(f"`{p}`" for p in parts))


class Frames:
    """DataFrames by name, with or without a schema in front (``tenant_001.orders``)."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def tables(self) -> list[Table]:
        return [_of(name.rpartition(".")[0], name.rpartition(".")[2], df.schema) for name, df in self.frames.items()]

    def df(self, name: str) -> DataFrame:
        return self.frames[name]


class Remote:
    """Tables of a warehouse reached through a Spark connector (``jdbc``, ``snowflake``, ``bigquery``), whose jar has to
    be on the class path. ``listing`` is the query that names tables; the rest is pushed down by the connector."""

    LISTING = "SELECT table_schema, table_name FROM information_schema.tables WHERE upper(table_schema) <> 'INFORMATION_SCHEMA'"

    def __init__(self, spark: SparkSession, kind: str, options: dict[str, str], listing: str = LISTING):
        self.spark, self.kind, self.options, self.listing = spark, kind, options, listing

    def _read(self, key: str, value: str) -> DataFrame:
        return self.spark.read.format(self.kind).options(**self.options).option(key, value).load()

    def tables(self) -> list[Table]:
        return [_of(r[0], r[1], self.df(f"{r[0]}.{r[1]}").schema) for r in sorted(self._read("query", self.listing).collect())]

    def df(self, name: str) -> DataFrame:
        return self._read("dbtable", name)


def open_source(spark: SparkSession, uri: str) -> Source:
    """``parquet:<folder>``, ``catalog:<database>`` (empty: all), ``iceberg:<catalog.database>``, or
    ``jdbc:``/``snowflake:``/``bigquery:`` followed by ``key=value`` options joined by ``;``."""
    kind, _, rest = uri.partition(":")
    if kind == "parquet" and rest:
        return ParquetDir(spark, rest)
    if kind in ("catalog", "iceberg"):
        return Catalog(spark, rest or None)
    if kind in ("jdbc", "snowflake", "bigquery"):
        return Remote(spark, kind, dict(x.split("=", 1) for x in rest.split(";") if "=" in x))
    raise ValueError(f"unknown source {uri!r}: expected parquet:, catalog:, iceberg:, jdbc:, snowflake: or bigquery:")


#: Statement kinds that change a schema, as query histories name them.
DDL = ("CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE", "CREATE_TABLE_AS_SELECT", "RENAME_TABLE", "ALTER_TABLE_ADD_COLUMN", "ALTER_TABLE_DROP_COLUMN", "CREATE_VIEW", "DROP_VIEW")


def ddl_events(history: DataFrame, minutes: int, now: datetime, limit: int = 100) -> DataFrame:
    """The last schema changes of a query history (query_type, start_time, ...), newest first."""
    since = F.lit(now - timedelta(minutes=minutes))
    return history.where(F.upper("query_type").isin(*DDL) & (F.col("start_time") >= since)).orderBy(F.desc("start_time")).limit(limit)
