"""Aggregates that stay right across joins, snapshots and versions, and reconciliation of aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far an aggregate may be off, how many groups must agree, how many statuses are tried.
ABSOLUTE, RELATIVE, COVERED, STATUSES = 0.02, 0.002, 0.95, 6

AGGS = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "median": F.median,
}


def aggregate(name: str, c: Column) -> Column:
    """Unknown names are sums."""
    return AGGS.get(name, F.sum)(c)


def ratio(top: Column, bottom: Column) -> Column:
    return F.sum(top).cast("double") / F.nullif(F.sum(bottom), F.lit(0))


def once_per_key(df: DataFrame, key: str | list[str], measure: str, how: str = "sum", by: list[str] | None = None) -> DataFrame:
    """Symmetric aggregate: joins multiply rows of ``key``; each counts once in each group."""
    keys = [key] if isinstance(key, str) else key
    by = by or []
    single = df.groupBy(*dict.fromkeys([*by, *keys])).agg(F.first(measure).alias(measure))
    return single.groupBy(*by).agg(aggregate(how, F.col(measure)).alias(measure))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Semi-additive measures: the last row of each key. Ties in ``order`` are to be broken by its later columns."""
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_row")  # partial on each side of the shuffle
    return df.groupBy(*keys).agg(row).select("_row.*")


def latest_snapshot(df: DataFrame, snapshot: str) -> DataFrame:
    """Rows of the last snapshot. The maximum is one row, so it is broadcast."""
    return df.join(F.broadcast(df.agg(F.max(snapshot).alias("_last"))), F.col(snapshot) == F.col("_last")).drop("_last")


def share_of_total(df: DataFrame, by: list[str], measure: str, alias: str) -> DataFrame:
    """Groups and their share. The total is one row that joins the few groups, so no rows meet in one task."""
    groups = df.groupBy(*by).agg(F.sum(measure).alias(measure))
    total = groups.agg(F.sum(measure).alias("_total"))
    return groups.join(F.broadcast(total)).withColumn(alias, F.col(measure).cast("double") / F.nullif(F.col("_total").cast("double"), F.lit(0.0))).drop("_total")


def exact(c: Column) -> Column:
    """Amounts as wide decimals: sums of them don't depend on the order of rows."""
    return c.cast("decimal(28,8)")


def cents(total: Column) -> Column:
    return F.round(total, 2).cast("decimal(28,2)")


def group_sums(df: DataFrame, key: str, measure: str, keep: Column | None = None) -> DataFrame:
    """(k, total): sums by key as decimals, so that they compare exactly; rows are added in full and the sum is rounded
    once. Groups without a value are left out."""
    df = df if keep is None else df.where(keep)
    return df.groupBy(F.col(key).alias("k")).agg(cents(F.sum(exact(F.col(measure)))).alias("total")).where("total is not null")


def close(a: Column, f: Column) -> Column:
    return F.abs(a - f) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.abs(a))


def match_by_key(agg: DataFrame, fact: DataFrame) -> DataFrame:
    """One row (n_groups, n_matched): keys of either side, and those whose sums are close."""
    both = agg.select("k", F.col("total").alias("a")).join(fact.select("k", F.col("total").alias("f")), "k", "full_outer")
    return both.agg(F.count("*").alias("n_groups"), F.count(F.when(close(F.col("a").cast("double"), F.col("f").cast("double")), 1)).alias("n_matched"))


def match_by_rank(agg: DataFrame, fact: DataFrame) -> DataFrame:
    """The same where keys differ in form (a date and its number): sums are paired in their order.

    Equal sums count once with their number, and cumulated numbers pair the two sides: what is ordered is the table of
    distinct sums of an aggregate table, not rows of facts."""
    w = Window.orderBy("total").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def spans(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("total").agg(F.count(F.lit(1)).alias("n")).withColumn("_to", F.sum("n").over(w))
        return n.select(F.col("total").alias(name), F.explode(F.sequence(F.col("_to") - F.col("n"), F.col("_to") - 1)).alias("at"))

    both = spans(agg, "a").join(spans(fact, "f"), "at", "full_outer")
    return both.agg(F.count("*").alias("n_groups"), F.count(F.when(close(F.col("a").cast("double"), F.col("f").cast("double")), 1)).alias("n_matched"))


def hypotheses(agg: DataFrame, fact: DataFrame, key: str, measure: str, status: str, values: list[str], fact_key: str | None = None) -> DataFrame:
    """(excluded, n_groups, n_matched) for every status value left out of the fact, and for none, in one pass.

    ``agg`` is (k, total). All conditional sums come from one group-by; the fact is read once."""
    amount = exact(F.col(measure))
    names = [None, *values]
    sums = [cents(F.sum(amount if v is None else F.when(F.col(status) != v, amount))).alias(f"_s{i}") for i, v in enumerate(names)]
    by_key = fact.groupBy(F.col(fact_key or key).alias("k")).agg(*sums)
    both = agg.join(by_key, "k", "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(v).cast("string").alias("excluded"), F.lit(i).alias("nth"), F.col(f"_s{i}").alias("f")) for i, v in enumerate(names)]))
    stacked = both.select(F.col("total").alias("a"), each.alias("h")).where("a is not null or h.f is not null")
    good = close(F.col("a").cast("double"), F.col("h.f").cast("double"))
    return stacked.groupBy(F.col("h.excluded").alias("excluded"), F.col("h.nth").alias("nth")).agg(F.count("*").alias("n_groups"), F.count(F.when(good, 1)).alias("n_matched")).drop("nth")


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n_a, n_ab, holds): does ``a`` decide ``b``?"""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    return pairs.agg(F.count_distinct(a).alias("n_a"), F.count("*").alias("n_ab")).withColumn("holds", F.col("n_a") == F.col("n_ab"))


def violations(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Groups that break an invariant; ``condition`` is over aggregates."""
    return df.groupBy(*keys).agg(condition.alias("_bad")).where("_bad").drop("_bad")


def time_attributes(dates: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """One row for each integer column of a calendar table: on how many dates it equals the quarter, month and year,
    how far it is from the year at most, its range and its number of values. One aggregate over all columns."""
    d = F.col(date)
    measured = []
    for c in columns:
        v = F.col(c).cast("long")
        n = lambda same: F.count(F.when(same, 1))
        measured.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), n(v == F.quarter(d)).alias("quarter_hits"), n(v == F.month(d)).alias("month_hits"), n(v == F.year(d)).alias("year_hits"),
                F.max(F.abs(v - F.year(d))).alias("year_off"), F.min(v).alias("low"), F.max(v).alias("high"),
            )
        )
    return dates.agg(F.array(*measured).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def freshness(df: DataFrame, date: str) -> DataFrame:
    """One row (n_dates, span_days, cadence). Distinct dates count, so many events a day are still one date."""
    d = F.to_date(date)
    out = df.select(d.alias("d")).distinct().agg(F.count("d").alias("n_dates"), F.datediff(F.max("d"), F.min("d")).alias("span_days"))
    share = F.col("n_dates") / F.greatest(F.col("span_days"), F.lit(1))
    return out.withColumn("cadence", F.when(share > 0.6, "daily").when(share > 0.1, "weekly").otherwise("sporadic"))
