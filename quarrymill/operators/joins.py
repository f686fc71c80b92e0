"""Inclusion dependencies, decodes, semi and anti joins, point-in-time joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import family


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def canonical(df: DataFrame, column: str) -> Column:
    """A value as text, the same for equal values of one type family: 1 and 1.00 are equal numbers. No digit is lost;
    NaN is a value like any other."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if family(kind) != "num" or _whole(kind):
        return c.cast("timestamp_ntz").cast("string") if family(kind) == "temporal" else c.cast("string")
    whole = F.floor(c).cast("decimal(38,0)")
    if isinstance(kind, T.DecimalType):
        part = c.cast("double")
        text = F.when(part.cast(kind) == c, part.cast("string")).otherwise(F.regexp_replace(c.cast("string"), "0+$", ""))
        return F.when(F.floor(c) == c, whole.cast("string")).otherwise(text)
    return F.when((F.abs(c) < 1e38) & (c == F.floor(c)), whole.cast("string")).otherwise(c.cast("double").cast("string"))


def comparable(a: DataFrame, x: str, b: DataFrame, y: str) -> tuple[Column, Column]:
    """Two columns as one type in which equal values are equal: their own if they share it, else a common number;
    text only where types are unlike."""
    left, right = a.schema[x].dataType, b.schema[y].dataType
    own = F.col(f"`{x}`"), F.col(f"`{y}`")
    if left == right:
        return own
    if _whole(left) and _whole(right):
        return own[0].cast("long"), own[1].cast("long")
    if isinstance(left, T.FractionalType) and isinstance(right, T.FractionalType) and not T.DecimalType in (type(left), type(right)):
        return own[0].cast("double"), own[1].cast("double")
    return canonical(a, x), canonical(b, y)


def inclusion(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row (n_distinct, misses, ratio): how much of the child's distinct non-null values the parent has."""
    mine, theirs = comparable(child, column, parent, parent_column)
    own = child.select(mine.alias("v")).where("v is not null").distinct()
    there = parent.select(theirs.alias("v")).where("v is not null").distinct()
    met = own.join(there.withColumn("hit", F.lit(1)), "v", "left").agg(F.count("*").alias("n_distinct"), F.count(F.when(F.col("hit").isNull(), 1)).alias("misses"))
    return met.withColumn("ratio", F.when(F.col("n_distinct") > 0, 1 - F.col("misses") / F.col("n_distinct")).otherwise(0.0))


def inclusion_matrix(columns: dict[str, tuple[DataFrame, str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """(child, parent, n_distinct, matches, ratio) of all ``pairs`` of column names, in one job.

    Distinct values of all columns are stacked with the set of columns that hold each: one shuffle by value. A value
    then counts for every pair it belongs to, so no join is needed and a value in k columns is one row.
    """
    first = next(iter(columns.values()))[0].sparkSession
    families: dict[str, list[tuple[str, DataFrame, str]]] = {}
    for name, (df, c) in columns.items():
        families.setdefault(family(df.schema[c].dataType), []).append((name, df, c))
    each_held = []
    for own in families.values():  # whole numbers as such, all else as text
        whole = all(_whole(df.schema[c].dataType) for _, df, c in own)
        stacked = reduce(DataFrame.unionAll, [df.select((F.col(f"`{c}`").cast("long") if whole else canonical(df, c)).alias("v"), F.lit(name).alias("c")).where("v is not null").distinct() for name, df, c in own])
        each_held.append(stacked.groupBy("v").agg(F.collect_set("c").alias("held")).select("held"))
    held = reduce(DataFrame.unionAll, each_held)
    wanted = F.broadcast(first.createDataFrame(pairs, "child string, parent string"))  # pairs of column names
    each = held.select(F.explode("held").alias("child"), "held").groupBy("child", "held").agg(F.count(F.lit(1)).alias("n"))
    met = each.join(wanted, "child").groupBy("child", "parent").agg(F.sum("n").alias("n_distinct"), F.sum(F.when(F.array_contains("held", F.col("parent")), F.col("n")).otherwise(0)).alias("matches"))
    return wanted.join(met, ["child", "parent"], "left").select("child", "parent", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.col("matches") / F.col("n_distinct"), F.lit(0.0)).alias("ratio"))


def decode(df: DataFrame, key: str, dim: DataFrame, dim_key: str, label: str, alias: str, limit: int = 100) -> DataFrame:
    """``df`` with the dimension's label. The dimension is broadcast only when it has at most ``limit`` rows."""
    small = dim.select(F.col(dim_key).alias(key), F.col(label).alias(alias))
    known = small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if known else small, key, "left")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def having(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key the other side has."""
    return child.join(parent.select(F.col(parent_column).alias(column)), column, "left_semi")


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], on: str, valid_from: str, valid_to: str, how: str = "inner") -> DataFrame:
    """Each fact with the version valid at ``on`` (both ends included, open end null); of overlapping versions the
    latest. Equi-join on the key with a range condition; the window guards against several matches."""
    fact = facts.withColumn("_row", F.monotonically_increasing_id())
    other = versions.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in versions.columns if c not in keys])
    match = reduce(Column.__and__, [fact[k] == other[f"_k{i}"] for i, k in enumerate(keys)])
    valid = (fact[on] >= other[valid_from]) & (other[valid_to].isNull() | (fact[on] <= other[valid_to]))
    joined = fact.join(other, match & valid, how).drop(*[f"_k{i}" for i in range(len(keys))])
    latest = Window.partitionBy("_row").orderBy(F.desc_nulls_last(valid_from))
    return joined.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_row")


def last_before(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, alias: str) -> DataFrame:
    """True as-of join without a range join: both sides in one time line, the last right value carried forward."""
    cols = [c for c in left.columns if c not in keys]
    line = left.select(*keys, *cols, F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn(alias, F.last("_v", True).over(w)).where("_side = 1").select(*left.columns, alias)


def overlaps(versions: DataFrame, keys: list[str], valid_from: str, valid_to: str, ties: list[str] | None = None) -> DataFrame:
    """Versions that begin before an earlier one of their key ends: a window, not a self-join. Of versions that begin
    at once the first by ``ties`` counts as the earlier one."""
    w = Window.partitionBy(*keys).orderBy(valid_from, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.max(F.col(valid_to).isNull()).over(w)
    return versions.withColumn("_end", F.max(valid_to).over(w)).withColumn("_open", open_end).where(F.col("_open") | (F.col(valid_from) <= F.col("_end"))).drop("_end", "_open")
