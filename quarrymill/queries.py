"""Registered queries over the driver tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import drift, hierarchy, joins, profile, text
from .plans import compile as C
from .plans.model import driver_model
from .sources.tables import ParquetDir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


# --- profiling -----------------------------------------------------------------------------------------------------

_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "lang", "source", "n_chars"],
}
_TEXT = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"]}
_NUMBER = {"customer": ["c_custkey", "c_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_totalprice"]}


def _counts(table: str):
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, table).select(*_COLUMNS[table])
        base = profile.counts(df)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__null").alias("n_null")) for c in df.columns])).alias("x")
        out = base.select("row_count", each).select("row_count", "x.*").join(profile.distincts(df), "column")
        return out.select("column", "row_count", "n_null", "n_distinct", ((F.col("row_count") > 0) & (F.col("n_null") == 0) & (F.col("row_count") == F.col("n_distinct"))).alias("is_unique"))

    return run


for _table, _cols in _COLUMNS.items():
    query(
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique FROM {_table}" for c in _cols),
        f"profile_counts_{_table}",
    )(_counts(_table))


def _minmax(table: str):
    cols, texts = _NUMBER[table], _TEXT[table]

    def run(spark, sf_dir):
        base = profile.counts(_t(spark, sf_dir, table).select(*cols, *texts))
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").cast("double").alias("low"), F.col(f"{c}__max").cast("double").alias("high"), F.lit(None).cast("string").alias("low_text"), F.lit(None).cast("string").alias("high_text"), F.lit(None).cast("double").alias("avg_len")) for c in cols]
        rows += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col(f"{c}__min").alias("low_text"), F.col(f"{c}__max").alias("high_text"), F.col(f"{c}__len").alias("avg_len")) for c in texts]
        return base.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

    return run


for _table in _TEXT:
    query(
        " UNION ALL ".join(
            [f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS low_text, CAST(NULL AS VARCHAR) AS high_text, CAST(NULL AS DOUBLE) AS avg_len FROM {_table}" for c in _NUMBER[_table]]
            + [f"SELECT '{c}', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), min({c}), max({c}), avg(length({c})) FROM {_table}" for c in _TEXT[_table]]
        ),
        f"profile_minmax_len_{_table}",
    )(_minmax(_table))

for _table, _column in (("events", "event_type"), ("orders", "o_orderpriority"), ("customer", "c_nationkey"), ("lineitem", "l_quantity"), ("documents", "source")):
    query(
        f"SELECT {_column} AS value, count(*) AS n FROM {_table} WHERE {_column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
        f"profile_topk_{_column}",
    )(lambda spark, sf_dir, t=_table, c=_column: profile.top_values(_t(spark, sf_dir, t), c))


@query("SELECT sum(CASE WHEN regexp_matches(url, '^https?://') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS url_share, sum(CASE WHEN regexp_matches(url, '^[^@\\s]+@[^@\\s]+\\.[a-zA-Z]{2,}$') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS email_share FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)")
def typing_value_pattern(spark, sf_dir):
    urls = _t(spark, sf_dir, "pages").where("url is not null").select("url").distinct()
    share = lambda p: F.count(F.when(F.col("url").rlike(p), 1)) / F.count("*")
    return urls.agg(share("^https?://").alias("url_share"), share(r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$").alias("email_share"))


# --- joins ---------------------------------------------------------------------------------------------------------


def _inclusion_sql(child: str, c: str, parent: str, p: str) -> str:
    return (
        f"WITH own AS (SELECT DISTINCT {c} AS v FROM {child} WHERE {c} IS NOT NULL), miss AS (SELECT v FROM own EXCEPT SELECT {p} FROM {parent}) "
        "SELECT (SELECT count(*) FROM own) AS n_distinct, (SELECT count(*) FROM miss) AS misses, CASE WHEN (SELECT count(*) FROM own) = 0 THEN 0.0::DOUBLE ELSE 1 - (SELECT count(*) FROM miss)::DOUBLE / (SELECT count(*) FROM own) END AS ratio"
    )


@query(_inclusion_sql("events", "user_id", "customer", "c_custkey"))
def inclusion_full(spark, sf_dir):
    return joins.inclusion(_t(spark, sf_dir, "events"), "user_id", _t(spark, sf_dir, "customer"), "c_custkey")


@query(_inclusion_sql("documents", "doc_id", "labels", "doc_id"))
def inclusion_partial(spark, sf_dir):
    return joins.inclusion(_t(spark, sf_dir, "documents"), "doc_id", _t(spark, sf_dir, "labels"), "doc_id")


_CHILDREN = [("events", "user_id"), ("orders", "o_custkey"), ("lineitem", "l_partkey"), ("documents", "doc_id"), ("customer", "c_nationkey")]
_PARENTS = [("customer", "c_custkey"), ("part", "p_partkey"), ("labels", "doc_id"), ("nation", "n_nationkey")]
_PAIRS = [(c, p) for c in _CHILDREN for p in _PARENTS]


@query(
    " UNION ALL ".join(
        f"SELECT '{ct}.{cc}' AS child, '{pt}.{pc}' AS parent, count(*) AS n_distinct, count(*) FILTER (hit) AS matches, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (hit)::DOUBLE / count(*) END AS ratio FROM (SELECT v, v IN (SELECT {pc} FROM {pt} WHERE {pc} IS NOT NULL) AS hit FROM (SELECT DISTINCT {cc} AS v FROM {ct} WHERE {cc} IS NOT NULL))"
        for (ct, cc), (pt, pc) in _PAIRS
    )
)
def inclusion_matrix(spark, sf_dir):
    columns = {f"{t}.{c}": (_t(spark, sf_dir, t), c) for t, c in {*_CHILDREN, *_PARENTS}}
    return joins.inclusion_matrix(columns, [(f"{a}.{b}", f"{c}.{d}") for (a, b), (c, d) in _PAIRS])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_anti(spark, sf_dir):
    return joins.orphans(_t(spark, sf_dir, "documents"), "doc_id", _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def in_semi(spark, sf_dir):
    return joins.having(_t(spark, sf_dir, "orders"), "o_orderkey", _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def decode_join(spark, sf_dir):
    return joins.decode(_t(spark, sf_dir, "nation"), "n_regionkey", _t(spark, sf_dir, "region"), "r_regionkey", "r_name", "region").select("n_nationkey", "n_name", "region")


@query("SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join(spark, sf_dir):
    o, c, n, r = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"))


_VERSIONS_SQL = "SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 MICROSECOND AS valid_to, event_id AS version FROM events WHERE event_type = 'signup'"


def _versions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select("user_id", F.col("ts").alias("valid_from"), (F.lead("ts").over(w) - F.expr("INTERVAL 0.000001 SECOND")).alias("valid_to"), F.col("event_id").alias("version"))


@query(f"WITH v AS ({_VERSIONS_SQL}) SELECT version, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS spent FROM events e JOIN v ON e.user_id = v.user_id AND e.ts >= v.valid_from AND (v.valid_to IS NULL OR e.ts <= v.valid_to) WHERE e.event_type = 'purchase' GROUP BY 1")
def scd2_asof(spark, sf_dir):
    bought = _t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of(bought, _versions(spark, sf_dir), ["user_id"], "ts", "valid_from", "valid_to").groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("spent"))


@query("SELECT e.event_id, (SELECT max_by(v.value, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts) AS last_view FROM events e WHERE e.event_type = 'purchase'")
def asof_last_value(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    seen = A.last_per_key(e.where("event_type = 'view'"), ["user_id", "ts"], ["event_id"]).select("user_id", F.col("ts").alias("seen_at"), "value")
    return joins.last_before(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), seen, ["user_id"], "ts", "seen_at", "value", "last_view").select("event_id", "last_view")


_MONTHS_SQL = "SELECT user_id, event_id AS version, ts AS valid_from, ts + INTERVAL 30 DAY AS valid_to FROM events WHERE event_type = 'signup'"


@query(f"WITH v AS ({_MONTHS_SQL}) SELECT b.version FROM v b WHERE EXISTS (SELECT 1 FROM v a WHERE a.user_id = b.user_id AND (a.valid_from, a.version) < (b.valid_from, b.version) AND b.valid_from <= a.valid_to)")
def scd2_overlap(spark, sf_dir):
    """Versions of a month each that begin before an earlier one of their key ends."""
    v = _t(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("user_id", "event_id as version", "ts as valid_from", "ts + interval 30 days as valid_to")
    return joins.overlaps(v, ["user_id"], "valid_from", "valid_to", ["version"]).select("version")


# --- aggregates ----------------------------------------------------------------------------------------------------

_MONEY = "CAST(o_totalprice AS DECIMAL(28,8))"
_CENTS = f"CAST(round(sum({_MONEY}), 2) AS DECIMAL(28,2))"


@query(
    f"WITH a AS (SELECT o_custkey AS k, {_CENTS} AS t FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), f AS (SELECT o_custkey AS k, {_CENTS} AS t FROM orders GROUP BY 1) "
    "SELECT count(*) AS n_groups, count(*) FILTER (abs(a.t - f.t)::DOUBLE <= greatest(0.02, 0.002 * abs(a.t::DOUBLE))) AS n_matched FROM a FULL OUTER JOIN f ON a.k = f.k"
)
def reconcile_keyed(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return A.match_by_key(A.group_sums(o, "o_custkey", "o_totalprice", F.col("o_orderstatus") != "F"), A.group_sums(o, "o_custkey", "o_totalprice"))


@query(
    f"WITH a AS (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS k, {_CENTS} AS t FROM orders GROUP BY 1), f AS (SELECT CAST(o_orderdate AS DATE) AS k, {_CENTS} AS t FROM orders GROUP BY 1), "
    "ar AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM a), fr AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM f) "
    "SELECT count(*) AS n_groups, count(*) FILTER (abs(ar.t - fr.t)::DOUBLE <= greatest(0.02, 0.002 * abs(ar.t::DOUBLE))) AS n_matched FROM ar FULL OUTER JOIN fr ON ar.r = fr.r"
)
def reconcile_multiset(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    a = o.withColumn("day_key", F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return A.match_by_rank(A.group_sums(a, "day_key", "o_totalprice"), A.group_sums(o.withColumn("day", F.to_date("o_orderdate")), "day", "o_totalprice"))


@query(
    f"WITH a AS (SELECT o_custkey AS k, sum({_MONEY}) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), h AS (SELECT * FROM (VALUES (NULL), ('F'), ('O'), ('P')) x(excluded)), "
    f"f AS (SELECT h.excluded, o_custkey AS k, sum(CASE WHEN h.excluded IS NULL OR o_orderstatus <> h.excluded THEN {_MONEY} END) AS t FROM orders, h GROUP BY 1, 2), "
    "j AS (SELECT h.excluded, a.t AS a, f.t AS f FROM h CROSS JOIN (SELECT k FROM a UNION SELECT k FROM f) ks LEFT JOIN a ON a.k = ks.k LEFT JOIN f ON f.k = ks.k AND f.excluded IS NOT DISTINCT FROM h.excluded) "
    "SELECT excluded, count(*) AS n_groups, count(*) FILTER (abs(a::DOUBLE - f::DOUBLE) <= greatest(0.02, 0.002 * abs(a::DOUBLE))) AS n_matched FROM j WHERE a IS NOT NULL OR f IS NOT NULL GROUP BY 1"
)
def reconcile_hypotheses(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return A.hypotheses(A.group_sums(o, "o_custkey", "o_totalprice", F.col("o_orderstatus") != "P"), o, "o_custkey", "o_totalprice", "o_orderstatus", ["F", "O", "P"])


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def fanout_naive(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT l_returnflag, CAST(sum(p) AS DOUBLE) AS total FROM (SELECT DISTINCT l_returnflag, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def fanout_safe(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    joined = o.join(li, o.o_orderkey == li.l_orderkey).withColumn("total", F.col("o_totalprice").cast("decimal(18,2)"))
    return A.once_per_key(joined, "o_orderkey", "total", by=["l_returnflag"]).withColumn("total", F.col("total").cast("double"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_per_key(spark, sf_dir):
    return A.last_per_key(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1")
def latest_snapshot(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.latest_snapshot(e, "day").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS share FROM orders GROUP BY 1")
def share_of_total(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return A.share_of_total(o, ["o_orderpriority"], "amount", "share").select("o_orderpriority", "share")


@query("SELECT (SELECT count(*) FROM customer)::DOUBLE / (SELECT count(*) FROM supplier) AS per_supplier, (SELECT max(c_custkey) FROM customer) + (SELECT max(s_suppkey) FROM supplier) AS keys")
def cross_fact_scalar(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").agg(F.count("*").alias("c"), F.max("c_custkey").alias("ck"))
    s = _t(spark, sf_dir, "supplier").agg(F.count("*").alias("s"), F.max("s_suppkey").alias("sk"))
    return c.join(s).select((F.col("c").cast("double") / F.col("s")).alias("per_supplier"), (F.col("ck") + F.col("sk")).alias("keys"))  # one row each


@query("SELECT 'customer' AS tenant, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_tenants(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("tenant"), F.col("c_nationkey").alias("nation"))
    s = _t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("tenant"), F.col("s_nationkey").alias("nation"))
    return c.unionAll(s).groupBy("tenant", "nation").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2 HAVING count(*) > 15 AND min(c_acctbal) < 0")
def having_violations(spark, sf_dir):
    return A.violations(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], (F.count("*") > 15) & (F.min("c_acctbal") < 0))


@query("SELECT count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers, count(DISTINCT user_id) AS users FROM events")
def filter_agg(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.agg(F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(DISTINCT n_name) AS n_a, count(DISTINCT (n_name, n_regionkey)) AS n_ab, count(DISTINCT n_name) = count(DISTINCT (n_name, n_regionkey)) AS holds FROM nation")
def fd_test(spark, sf_dir):
    return A.functional_dependency(_t(spark, sf_dir, "nation"), "n_name", "n_regionkey")


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def hierarchy_rollup(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


_CALENDAR = "SELECT CAST(o_orderdate AS DATE) AS d, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(year(o_orderdate) AS INTEGER) AS y, CAST((month(o_orderdate) + 10) % 12 // 3 + 1 AS INTEGER) AS fq FROM orders GROUP BY ALL"


def _calendar(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", F.month("d").alias("m"), F.quarter("d").alias("q"), F.year("d").alias("y"), F.expr("cast((month(d) + 10) % 12 div 3 + 1 as int)").alias("fq"))


@query(
    f"WITH c AS ({_CALENDAR}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER ({c} = quarter(d)) AS quarter_hits, count(*) FILTER ({c} = month(d)) AS month_hits, count(*) FILTER ({c} = year(d)) AS year_hits, CAST(max(abs({c} - year(d))) AS BIGINT) AS year_off, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM c"
        for c in ("m", "q", "y", "fq")
    )
)
def time_attribute_check(spark, sf_dir):
    return A.time_attributes(_calendar(spark, sf_dir), "d", ["m", "q", "y", "fq"])


@query(f"WITH c AS ({_CALENDAR}) SELECT fq, count(*) AS n, CAST(sum({_MONEY}) AS DOUBLE) AS total FROM orders JOIN c ON CAST(o_orderdate AS DATE) = c.d GROUP BY 1")
def fiscal_bucket(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.join(_calendar(spark, sf_dir), "d").groupBy("fq").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT n_dates, span_days, CASE WHEN n_dates / greatest(span_days, 1) > 0.6 THEN 'daily' WHEN n_dates / greatest(span_days, 1) > 0.1 THEN 'weekly' ELSE 'sporadic' END AS cadence FROM (SELECT count(DISTINCT CAST(ts AS DATE)) AS n_dates, CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS INTEGER) AS span_days FROM events)")
def freshness(spark, sf_dir):
    return A.freshness(_t(spark, sf_dir, "events"), "ts")


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('signup', 'click')")
def enum_drift(spark, sf_dir):
    return drift.unknown_values(_t(spark, sf_dir, "events"), "event_type", ["signup", "click"])


@query("SELECT max(CAST(ts AS DATE)) AS last_date, CAST(date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-10') AS INTEGER) AS days_behind, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-10') > 2 AS is_stale FROM events")
def stale_load(spark, sf_dir):
    return drift.stale(_t(spark, sf_dir, "events"), "ts", "daily", date(2024, 2, 10))


@query("SELECT g.expected, f.found, count(*) AS n FROM (SELECT doc_id, quality AS expected FROM labels) g LEFT JOIN (SELECT doc_id, CAST(n_chars > 1000 AS INTEGER) AS found FROM documents) f ON g.doc_id = f.doc_id GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    """Quality labels against a rule of length."""
    from .plans import scoring

    guess = _t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return scoring.confusion(guess, _t(spark, sf_dir, "labels"), ["doc_id"], "quality")


@query("SELECT count(*) AS n_users, CAST(sum(CASE WHEN d.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong_filter, CAST(sum(o.n) AS BIGINT) AS n_naive, CAST(sum(o.last) AS BIGINT) AS n_right FROM (SELECT user_id, count(*) AS n, 1 AS last FROM events WHERE event_type = 'signup' GROUP BY 1) o LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) d ON o.user_id = d.user_id")
def scd2_canary(spark, sf_dir):
    """Users counted by version rows, the wrong answer, beside users counted by their last version, the right one."""
    e = _t(spark, sf_dir, "events")
    signups = e.where("event_type = 'signup'")
    last = A.last_per_key(signups, ["user_id"], ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("last"))
    naive = signups.groupBy("user_id").agg(F.count("*").alias("n"))
    bought = e.where("event_type = 'purchase'").select("user_id").distinct().withColumn("b", F.lit(1))
    both = naive.join(last, "user_id").join(bought, "user_id", "left")
    return both.agg(F.count("*").alias("n_users"), F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).alias("n_wrong_filter"), F.sum("n").alias("n_naive"), F.sum("last").alias("n_right"))


# --- hierarchies ---------------------------------------------------------------------------------------------------

_TREE = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey = 1 THEN NULL ELSE CAST(p_partkey // 6 + CASE WHEN p_partkey < 6 THEN 1 ELSE 0 END AS BIGINT) END AS up FROM part"


def _tree(spark, sf_dir):
    return _t(spark, sf_dir, "part").selectExpr("p_partkey as id", "case when p_partkey = 1 then null else p_partkey div 6 + case when p_partkey < 6 then 1 else 0 end end as up")


@query(f"WITH RECURSIVE t AS ({_TREE}), w AS (SELECT id, 1 AS level FROM t WHERE up IS NULL UNION ALL SELECT t.id, level + 1 FROM w JOIN t ON t.up = w.id) SELECT level, count(*) AS n FROM w GROUP BY 1")
def recursive_depth(spark, sf_dir):
    return hierarchy.depths(_tree(spark, sf_dir), "id", "up").groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE t AS ({_TREE}), w AS (SELECT 1::BIGINT AS root, id AS part, (id % 3 + 1)::DOUBLE AS qty FROM t WHERE up = 1 UNION ALL SELECT root, t.id, qty * (t.id % 3 + 1) FROM w JOIN t ON t.up = w.part) SELECT root, part, sum(qty) AS qty FROM w GROUP BY 1, 2")
def bom_explosion(spark, sf_dir):
    tree = _tree(spark, sf_dir).where("up is not null").withColumn("qty", F.col("id") % 3 + 1)
    return hierarchy.explode_bom(tree, spark.createDataFrame([(1,)], "root long"), "up", "id", "qty")


_RING = "SELECT DISTINCT n_nationkey AS p, (n_nationkey * 2 + 1) % 25 AS c FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey = 24 UNION SELECT n_nationkey + 100, (n_nationkey + 1) % 25 + 100 FROM nation"


@query(f"WITH RECURSIVE e AS ({_RING}), w AS (SELECT p AS id, c AS cur FROM e UNION SELECT w.id, e.c FROM w JOIN e ON w.cur = e.p) SELECT DISTINCT id FROM w WHERE id = cur")
def cycle_check(spark, sf_dir):
    """A ring of 25 nodes, a node that leads to itself, and paths that end."""
    n = _t(spark, sf_dir, "nation")
    paths = n.where("n_nationkey % 4 <> 0 or n_nationkey = 24").selectExpr("n_nationkey as p", "(n_nationkey * 2 + 1) % 25 as c")
    return hierarchy.in_cycles(paths.unionAll(n.selectExpr("n_nationkey + 100", "(n_nationkey + 1) % 25 + 100")), "p", "c")


# --- text ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 2)), ['and', 'ing', 'the', 'tion', 'with'])) AS INTEGER) AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def token_overlap_search(spark, sf_dir):
    return text.overlap(_t(spark, sf_dir, "documents"), "the and with tion ing")


@query()
def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("text"))


@query(
    "WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(chr(10) || text, '\\n(#{1,6} )', chr(1) || '\\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(chr(10) || text, '\\n(#{1,6} )', chr(1) || '\\1', 'g'), chr(1)), 1) - 1 AS position FROM documents) "
    "SELECT doc_id, CAST(position AS INTEGER) AS position, nullif(regexp_extract(part, '^#{1,6} ([^\\n]*)', 1), '') AS heading, trim(regexp_replace(part, '^#{1,6} [^\\n]*\\n?|^\\n', ''), ' ') AS body FROM p WHERE trim(regexp_replace(part, '\\s+', ' ', 'g')) <> ''"
)
def chunk_headings(spark, sf_dir):
    return text.chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"))


# --- compiled metrics ----------------------------------------------------------------------------------------------


def _metric(key: str, sql: str, metric: str, **kw):
    def run(spark, sf_dir):
        out = C.compile_metric(driver_model(), metric, source=ParquetDir(spark, sf_dir), **kw)
        if isinstance(out, C.Refusal):
            raise ValueError(out.reason)
        return out.df

    query(sql, key)(run)


_SUM = _CENTS
_metric("metric_simple", f"SELECT {_SUM} AS revenue FROM orders WHERE o_orderstatus <> 'P'", "revenue")
_metric("metric_group", f"SELECT o_orderpriority, {_SUM} AS revenue FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1", "revenue", group_by=["orders.o_orderpriority"])
_metric("metric_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1", "buyers", group_by=["orders.o_orderstatus"])
_metric("metric_median", "SELECT median(c_acctbal) AS typical_balance FROM customer", "typical_balance")
_metric("metric_ratio", "SELECT o_orderpriority, CAST(sum(o_orderkey) AS DOUBLE) / nullif(sum(o_custkey), 0) AS keys_per_customer FROM orders GROUP BY 1", "keys_per_customer", group_by=["orders.o_orderpriority"])
_metric("metric_hop2", f"SELECT n_name, {_SUM} AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY 1", "revenue", group_by=["nation.n_name"])
_metric("metric_hop3", f"SELECT r_name, {_SUM} AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY 1", "revenue", group_by=["region.r_name"])
_metric("metric_filter_dim", f"SELECT {_SUM} AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING'", "revenue", extra_filter="customer.c_mktsegment = 'BUILDING'")
for _grain in ("day", "week", "month", "quarter", "year"):
    _metric(
        f"metric_{_grain}",
        f"SELECT CAST(date_trunc('{_grain}', o_orderdate) AS TIMESTAMP) AS period, {_SUM} AS revenue FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
        "revenue", time_grain=_grain, time_start="1996-01-01", time_end="1998-01-01",
    )


# --- documents as tables -------------------------------------------------------------------------------------------


@query()
def infer_columns(spark, sf_dir):
    """Profile, typing, keys, links and enrichment of all tables, as one row a column."""
    from .plans.infer import infer
    from .plans.model import columns_frame

    doc, _ = infer(spark, ParquetDir(spark, sf_dir), "driver")
    return columns_frame(spark, doc)


@query()
def model_tables(spark, sf_dir):
    from .plans.model import columns_frame

    return columns_frame(spark, driver_model())


@query("SELECT 'table_dropped' AS kind, 'region' AS \"table\", CAST(NULL AS VARCHAR) AS \"column\", '' AS detail UNION ALL SELECT 'column_dropped', 'nation', 'n_regionkey', 'INTEGER' UNION ALL SELECT 'column_added', 'nation', 'n_zone', 'INTEGER'")
def schema_diff(spark, sf_dir):
    """A table goes, and a column of another is renamed."""
    before = ParquetDir(spark, sf_dir).tables()
    renamed = [replace(t, columns=tuple(("n_zone", k) if c == "n_regionkey" else (c, k) for c, k in t.columns)) if t.name == "nation" else t for t in before]
    after = [t for t in renamed if t.name != "region"]
    return drift.schema_diff(drift.schema_rows(spark, before), drift.schema_rows(spark, after))


@query("WITH RECURSIVE uses(element, needs) AS (VALUES ('relationship:orders_to_customer', 'customer.c_custkey'), ('metric:revenue', 'orders.o_totalprice')), w AS (SELECT element, 1 AS depth FROM uses WHERE needs = 'customer.c_custkey' UNION SELECT u.element, depth + 1 FROM w JOIN uses u ON u.needs = w.element) SELECT element, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def blast_radius(spark, sf_dir):
    from .plans.drift import blast_radius

    return spark.createDataFrame(sorted(blast_radius(driver_model(), "customer.c_custkey").items()), "element string, depth int")


@query("WITH RECURSIVE e(a, b) AS (VALUES ('lineitem', 'orders'), ('orders', 'customer'), ('customer', 'nation'), ('nation', 'region')), w AS (SELECT 'orders' AS name, 0 AS step UNION ALL SELECT e.b, step + 1 FROM w JOIN e ON e.a = w.name WHERE w.name <> 'region') SELECT CAST(step AS INTEGER) AS step, name FROM w")
def join_path(spark, sf_dir):
    from .plans.graph import join_path

    return spark.createDataFrame(list(enumerate(join_path(driver_model(), "orders", "region") or [])), "step int, name string")


@query()
def domains(spark, sf_dir):
    from .plans.enrich import domains

    return spark.createDataFrame([(d["name"], d["tables"]) for d in domains(driver_model())], "name string, tables array<string>")


@query("SELECT table_name AS \"table\", column_name AS \"column\", CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE data_type END AS sql_type FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')")
def list_tables(spark, sf_dir):
    """All tables of the folder with their columns and types."""
    from .functions.types import render

    rows = [(t.name, c, "TIMESTAMP" if render(k).startswith("TIMESTAMP") else render(k)) for t in ParquetDir(spark, sf_dir).tables() for c, k in t.columns]
    return spark.createDataFrame(rows, "table string, column string, sql_type string")


_RATED = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 1 - count({c})::DOUBLE / count(*) AS null_rate, count(DISTINCT {c})::DOUBLE / count({c}) AS cardinality_ratio FROM orders" for c in _RATED))
def profile_rates(spark, sf_dir):
    stats = profile.profile_table(_t(spark, sf_dir, "orders").select(*_RATED))
    return spark.createDataFrame([(c, float(x.null_rate), float(x.cardinality_ratio)) for c, x in stats.items()], "column string, null_rate double, cardinality_ratio double")


_REQUESTS = [
    ("known", "revenue", {}, False),
    ("unknown metric", "nothing", {}, True),
    ("unknown column", "revenue", {"group_by": ["orders.o_nothing"]}, True),
    ("fan-out", "revenue", {"group_by": ["lineitem.l_returnflag"]}, True),
    ("measure as a group", "revenue", {"group_by": ["orders.o_totalprice"]}, True),
    ("unknown grain", "revenue", {"time_grain": "decade"}, True),
    ("function in a condition", "revenue", {"extra_filter": "sleep(1) = 0"}, True),
    ("statement in a condition", "revenue", {"extra_filter": "1 = 1; drop table orders"}, True),
    ("subquery in a condition", "revenue", {"extra_filter": "o_custkey in (select 1)"}, True),
    ("fiscal without a column", "revenue", {"time_grain": "month", "calendar": "fiscal"}, True),
    ("condition of a dimension", "revenue", {"extra_filter": "customer.c_mktsegment = 'BUILDING'"}, False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {refused})" for name, _, _, refused in _REQUESTS) + ") t(request, refused)")
def metric_refusals(spark, sf_dir):
    """Which requests the compiler refuses."""
    source = ParquetDir(spark, sf_dir)
    told = [(name, isinstance(C.compile_metric(driver_model(), metric, source=source, **kw), C.Refusal)) for name, metric, kw, _ in _REQUESTS]
    return spark.createDataFrame(told, "request string, refused boolean")


_TYPED = [
    ("stg_orders", ["id"], ["amount"], 2, 0, "staging"),
    ("etl_run", ["id"], [], 0, 0, "operational"),
    ("etl_run", ["id", "n", "m", "k", "l"], [], 0, 1, "dimension"),
    ("store", ["id", "valid_from", "valid_to"], [], 1, 1, "snapshot_scd2"),
    ("store_hist", ["id"], ["n"], 2, 0, "snapshot_scd2"),
    ("stock", ["id", "is_current"], [], 0, 0, "snapshot_scd2"),
    ("sales_daily", ["day"], ["amount"], 1, 0, "aggregate"),
    ("store_mstr", ["id"], ["area"], 2, 0, "dimension"),
    ("wide", [f"c{i}" for i in range(51)], [], 0, 0, "denormalized"),
    ("sales", ["a", "b"], ["amount"], 2, 3, "fact"),
    ("sales", ["a", "b"], ["amount"], 1, 0, "fact"),
    ("colour", ["id", "colour_nm"], [], 0, 0, "dimension"),
    ("meter", ["id"], ["low", "high"], 0, 0, "fact"),
    ("lonely", ["id"], [], 0, 0, "operational"),
    ("meter", ["id"], ["low"], 0, 0, "unknown"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x[5]}')" for i, x in enumerate(_TYPED)) + ") t(nth, table_type)")
def table_types(spark, sf_dir):
    """Types of tables by names, columns and links."""
    from .plans.link import table_type

    told = []
    for i, (name, plain, measures, out, incoming, _) in enumerate(_TYPED):
        columns = [{"name": c, "entity_role": "dimension"} for c in plain] + [{"name": c, "entity_role": "measure"} for c in measures]
        told.append((i, table_type({"name": name, "columns": columns}, out, incoming)))
    return spark.createDataFrame(told, "nth int, table_type string")


_KEYS = "benchmark.item_id customer.c_custkey documents.doc_id embeddings.vec_id events.event_id nation.n_nationkey orders.o_orderkey pages.page_id part.p_partkey region.r_regionkey supplier.s_suppkey".split()
_LINKS = [("customer.c_nationkey", "nation.n_nationkey"), ("labels.doc_id", "documents.doc_id"), ("nation.n_regionkey", "region.r_regionkey"), ("supplier.s_nationkey", "nation.n_nationkey")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'primary_key', NULL)" for k in _KEYS) + ", " + ", ".join(f"('{a}', 'foreign_key', '{b}')" for a, b in _LINKS) + ") t(\"column\", role, \"references\")")
def infer_keys(spark, sf_dir):
    """Keys and the links between tables that inference finds, against those that the tables are made with."""
    found = infer_columns(spark, sf_dir).where("entity_role = 'primary_key' or references is not null")
    return found.select(F.concat_ws(".", "table", "column").alias("column"), F.col("entity_role").alias("role"), "references")
