"""Metric requests become lazy DataFrames and Spark SQL, or a refusal that says what would be allowed."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates

GRAINS = ("day", "week", "month", "quarter", "year")
HOPS, SHOWN = 3, 25
UNUSABLE = ("deprecated", "orphaned")
_WORD = re.compile(r"'(?:[^']|'')*'|`[^`]+`(?:\.`[^`]+`)?|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?\s*\(?|[0-9.]+")
_KEYWORDS = frozenset("and or not in like is null between true false case when then else end".split())
_OF_CASE = frozenset("when then else end".split())


@dataclass
class Refusal:
    reason: str
    group_bys: list[str] = field(default_factory=list)
    grains: list[str] = field(default_factory=list)


@dataclass
class Compiled:
    df: DataFrame | None
    sql: str
    warnings: list[str] = field(default_factory=list)


class _No(Exception):
    """Ends compilation with a reason."""


class Graph:
    """N:1 paths from a base table: the shortest, at most HOPS long. A table that two shortest paths reach, or that lies
    behind such a table, is ambiguous."""

    def __init__(self, doc: dict, base: str):
        usable = {t["name"] for t in doc["tables"] if t.get("lifecycle") not in UNUSABLE}
        edges: dict[str, list[dict]] = {}
        for r in doc.get("relationships", []):
            if r.get("cardinality", "many_to_one") in ("many_to_one", "one_to_one") and r.get("lifecycle") not in UNUSABLE and r["to"]["table"] in usable:
                edges.setdefault(r["from"]["table"], []).append(r)
        self.paths: dict[str, list[dict]] = {base: []}
        self.ambiguous: set[str] = set()
        todo = deque([base])
        while todo:
            at = todo.popleft()
            if len(self.paths[at]) == HOPS:
                continue
            for r in edges.get(at, []):
                to, path = r["to"]["table"], [*self.paths[at], r]
                if to not in self.paths:
                    self.paths[to] = path
                    todo.append(to)
                elif to != base and len(path) == len(self.paths[to]):
                    self.ambiguous.add(to)
        for t, path in self.paths.items():
            if any(r["to"]["table"] in self.ambiguous for r in path):
                self.ambiguous.add(t)


class _Request:
    def __init__(self, doc: dict, name: str):
        metrics = {m["name"]: m for m in doc.get("metrics", [])}
        if name not in metrics:
            raise _No(f"unknown metric {name!r}; known: {', '.join(sorted(metrics)[:SHOWN])}")
        self.doc, self.metrics, self.metric = doc, metrics, metrics[name]
        if self.metric.get("lifecycle") in UNUSABLE:
            raise _No(f"metric {name!r} is {self.metric['lifecycle']}")
        self.tables = {t["name"]: t for t in doc["tables"]}
        kind = self.metric.get("type", "simple")
        if kind == "derived":
            raise _No("derived metrics are not compiled; ask for their inputs: " + ", ".join(self.metric.get("input_metrics", [])))
        operands = [self._operand(self.metric[k]) for k in (("numerator", "denominator") if kind == "ratio" else ("measure",))]
        bases = {t for t, _, _ in operands}
        if len(bases) > 1:
            raise _No(f"a ratio across tables ({', '.join(sorted(bases))}) is not compiled")
        self.base, self.operands, self.kind = bases.pop(), operands, kind
        if self.base not in self.tables:
            raise _No(f"unknown table {self.base!r}")
        if self.tables[self.base].get("lifecycle") in UNUSABLE:
            instead = self.tables[self.base].get("deprecation", {}).get("replacement")
            raise _No(f"table {self.base!r} is {self.tables[self.base]['lifecycle']}" + (f"; use {instead}" if instead else ""))
        self.graph = Graph(doc, self.base)
        self.joins: list[dict] = []

    def _operand(self, name: str) -> tuple[str, str, str | None]:
        """(table, column, aggregate) of ``table.column`` or of a metric's name."""
        if name in self.metrics:
            m = self.metrics[name]
            t, _, c = m["measure"].partition(".")
            return t, c, m.get("agg", "sum")
        t, _, c = name.partition(".")
        return t, c, None

    def columns(self, table: str) -> dict[str, dict]:
        return {c["name"]: c for c in self.tables[table]["columns"]}

    def legal(self) -> list[str]:
        out = []
        for t in self.graph.paths:
            if t not in self.graph.ambiguous and t in self.tables:
                out += [f"{t}.{c}" for c, x in self.columns(t).items() if x.get("entity_role") != "measure" and x.get("lifecycle") not in UNUSABLE]
        return out

    def owner(self, name: str, groups: bool = False) -> tuple[str, str]:
        """The table and column of a name, bare or with its table; joins it."""
        t, dot, c = name.rpartition(".")
        if not dot:
            own = [x for x in ([self.base] if c in self.columns(self.base) else [x for x in self.graph.paths if x in self.tables and c in self.columns(x)])]
            if not own:
                raise _No(f"unknown column {name!r}")
            if len(own) > 1:
                raise _No(f"column {name!r} is in {', '.join(own)}: name the table")
            t = own[0]
        if t not in self.tables or c not in self.columns(t):
            raise _No(f"unknown column {name!r}")
        if t not in self.graph.paths:
            raise _No(f"{t} can't be reached from {self.base} over N:1 joins of at most {HOPS} steps")
        if t in self.graph.ambiguous:
            raise _No(f"the path from {self.base} to {t} is ambiguous")
        if groups and self.columns(t)[c].get("entity_role") == "measure":
            raise _No(f"{t}.{c} is a measure: no group-by")
        for r in self.graph.paths[t]:
            other = self.tables[r["to"]["table"]]
            if other.get("scd") and not r.get("asof", {}).get("enabled") and set(r["to"]["columns"]) != set(other.get("primary_key", [])):
                raise _No(f"{other['name']} keeps versions: the relationship {r.get('name')} needs an as-of date")
            if r not in self.joins:
                self.joins.append(r)
        return t, c

    def predicate(self, text: str) -> str:
        """A condition with every name qualified; unknown names are refused, as are subqueries and statements."""
        if re.search(r";|--|/\*|\bselect\b", text, re.I):
            raise _No(f"not a condition: {text!r}")

        def word(m: re.Match) -> str:
            w, low = m[0], m[0].lower().strip()
            typed = low in ("date", "timestamp") and text[m.end() :].lstrip()[:1] == "'"  # else a column of that name
            if w[0] in "'0123456789." or typed or low in (_KEYWORDS if re.search(r"\bcase\b", text, re.I) else _KEYWORDS - _OF_CASE):
                return w
            if w.rstrip().endswith("("):
                if w[:-1].strip().lower() in ("in", "and", "or", "not", "when", "then", "else", "between", "like", "is", "case"):
                    return w
                raise _No(f"functions are not allowed in conditions: {w.strip()}")
            return _quoted(*self.owner(w.replace("`", "").strip())) + w[len(w.rstrip()) :]

        return _WORD.sub(word, text)

    def time(self, grain: str | None, calendar: str | None) -> list[tuple[str, str]]:
        """(alias, SQL) of the period columns."""
        if grain is None:
            return []
        if grain not in GRAINS:
            raise _No(f"unknown grain {grain!r}")
        if calendar not in (None, "fiscal", "calendar"):
            raise _No(f"unknown calendar {calendar!r}")
        on = self.metric.get("agg_time_dimension")
        if not on:
            raise _No(f"metric {self.metric['name']!r} has no time dimension")
        t, c = self.owner(on)
        marks = {x.get("time_attribute"): n for n, x in self.columns(t).items() if x.get("time_attribute")}
        fiscal = {"quarter": marks.get("fiscal_quarter"), "year": marks.get("fiscal_year") or marks.get("year")}
        if grain in fiscal and any(m and m.startswith("fiscal") for m in marks):
            if calendar is None:
                raise _No(f"{grain} is ambiguous here: say calendar='fiscal' or 'calendar'")
            if calendar == "fiscal":
                year = marks.get("fiscal_year")
                if grain == "year":
                    if not year:
                        raise _No("there is no fiscal year column")
                    return [(year, _quoted(t, year))]
                if not fiscal["quarter"]:
                    raise _No("there is no fiscal quarter column")
                return [(n, _quoted(t, n)) for n in (year, fiscal["quarter"]) if n]
        elif calendar == "fiscal":
            raise _No("there is no fiscal calendar here")
        return [("period", f"date_trunc('{grain}', {_quoted(t, c)})")]

    def last_of(self, dims: list[tuple[str, str]]) -> str | None:
        """The snapshot column over which the measure doesn't add up, if the request needs its last value."""
        found = {self.columns(t).get(c, {}).get("aggregations", {}).get("semi_additive", {}).get("over") for t, c, _ in self.operands} - {None}
        return next((c for c in sorted(found) if (self.base, c) not in dims), None)

    def value(self) -> str:
        """The aggregate as SQL."""

        def one(operand, alone: bool) -> str:
            t, c, own = operand
            if c not in self.columns(t):
                raise _No(f"unknown column {t}.{c}")
            agg = (self.metric.get("agg") or own or "sum") if alone else (own or "sum")
            agg = agg if agg in aggregates.AGGS else "sum"
            column, sql = self.columns(t)[c], _quoted(t, c)
            if agg == "sum" and column.get("semantic_type") == "monetary_value" and column.get("sql_type") in ("DOUBLE", "FLOAT"):
                return f"CAST(round(sum(CAST({sql} AS DECIMAL(28,8))), 2) AS DECIMAL(28,2))"  # exact, whatever the order of rows
            return f"count(DISTINCT {sql})" if agg == "count_distinct" else f"{agg}({sql})"

        if self.kind == "ratio":
            top, bottom = (one(o, False) for o in self.operands)
            return f"CAST({top} AS DOUBLE) / nullif({bottom}, 0)"
        return one(self.operands[0], True)


def _quoted(table: str, column: str) -> str:
    return f"`{table}`.`{column}`"


def compile_metric(
    doc: dict, name: str, group_by: list[str] | None = None, time_grain: str | None = None, time_start: str | None = None, time_end: str | None = None,
    extra_filter: str | None = None, calendar: str | None = None, source=None, required_filters: bool = False, dialect: str = "spark",
) -> Compiled | Refusal:
    """A request as SQL and, with a ``source``, as a DataFrame. Only the joins that are asked for are made, all N:1 from
    the base, so no row is counted twice. Versioned dimensions join at the relationship's as-of date. A semi-additive
    measure counts its last snapshot only, unless the snapshot is grouped by. ``required_filters`` adds the filters that
    tables require. ``dialect`` (spark, duckdb, snowflake, bigquery) is that of the text."""
    request = None
    try:
        if dialect not in DIALECTS:
            raise _No(f"unknown dialect {dialect!r}")
        request = _Request(doc, name)
        dims = [request.owner(g, True) for g in group_by or []]
        periods = request.time(time_grain, calendar)
        where = []
        if request.metric.get("filter"):
            where.append(request.predicate(request.metric["filter"]))
        if time_start or time_end:
            on = request.metric.get("agg_time_dimension")
            if not on:
                raise _No(f"metric {name!r} has no time dimension")
            t, c = request.owner(on)
            where += [f"{_quoted(t, c)} {op} TIMESTAMP '{_moment(v)}'" for op, v in ((">=", time_start), ("<", time_end)) if v]
        if extra_filter:
            where.append(request.predicate(extra_filter))
        if required_filters:
            for t in [request.base, *[r["to"]["table"] for r in request.joins]]:
                where += [request.predicate(f["expr"]) for f in request.tables[t].get("knowledge", {}).get("required_filters", []) if f.get("enforcement", "required") == "required"]
        value = request.value()
        bare = [c for _, c in dims]
        names = [f"{t}_{c}" if bare.count(c) > 1 else c for t, c in dims]
        groups = [*periods, *[(n, _quoted(t, c)) for n, (t, c) in zip(names, dims, strict=True)]]
        last = request.last_of(dims)
        return Compiled(_frame(request, source, groups, where, value, last) if source is not None else None, DIALECTS[dialect](_text(request, groups, where, value, last)), _warnings(request))
    except _No as no:
        legal = request.legal() if request is not None else []
        return Refusal(str(no), legal[:SHOWN], list(GRAINS) if request is not None and request.metric.get("agg_time_dimension") else [])


def _moment(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d)?)?", text):
        raise _No(f"not a date: {text!r}")
    return text


def _warnings(request: _Request) -> list[str]:
    out = []
    if request.metric.get("lifecycle") == "inferred":
        sure = request.metric.get("confidence", 1.0)
        out.append("inferred, unreviewed" if sure >= 0.9 else "inferred with low confidence" if sure >= 0.6 else "a candidate only: not for answers")
    for t in [request.base, *[r["to"]["table"] for r in request.joins]]:
        out += [f"{t}: consider {f['expr']}" for f in request.tables[t].get("knowledge", {}).get("required_filters", []) if f.get("enforcement") == "advisory"]
    return out


def _on(request: _Request, r: dict) -> str:
    a, b = r["from"]["table"], r["to"]["table"]
    out = " AND ".join(f"{_quoted(a, x)} = {_quoted(b, y)}" for x, y in zip(r["from"]["columns"], r["to"]["columns"], strict=True))
    if r.get("asof", {}).get("enabled"):
        scd, on = request.tables[b]["scd"], _quoted(a, r["asof"]["on"].rpartition(".")[2])
        start, end = _quoted(b, scd["valid_from"]), _quoted(b, scd["valid_to"])
        out += f" AND {on} >= {start} AND ({end} IS NULL OR {on} <= {end})"
    return out


#: From Spark's text to others: quotes, and the order of arguments of date_trunc.
DIALECTS = {
    "spark": lambda sql: sql,
    "duckdb": lambda sql: sql.replace("`", '"'),
    "snowflake": lambda sql: sql.replace("`", '"'),
    "bigquery": lambda sql: re.sub(r"date_trunc\('(\w+)', ([^)]*)\)", lambda m: f"DATE_TRUNC({m[2]}, {m[1].upper()})", sql).replace("AS DOUBLE", "AS FLOAT64").replace("AS DECIMAL(18,2)", "AS NUMERIC"),
}


def _frame(request: _Request, source, groups, where, value: str, last: str | None) -> DataFrame:
    place = lambda t: request.tables[t].get("source") or t
    df = source.df(place(request.base))
    df = (aggregates.latest_snapshot(df, last) if last else df).alias(request.base)
    for r in request.joins:
        # no broadcast hint: the size of the side decides, by Spark's own threshold
        df = df.join(source.df(place(r["to"]["table"])).alias(r["to"]["table"]), F.expr(_on(request, r)), "left")
    if where:
        df = df.where(reduce(Column.__and__, [F.expr(w) for w in where]))
    alias = request.metric["name"]
    if not groups:
        return df.agg(F.expr(value).alias(alias))
    return df.groupBy(*[F.expr(sql).alias(n) for n, sql in groups]).agg(F.expr(value).alias(alias)).orderBy(*[n for n, _ in groups])


def _text(request: _Request, groups, where, value: str, last: str | None) -> str:
    place = lambda t: f"`{'`.`'.join((request.tables[t].get('source') or t).split('.'))}` AS `{t}`"
    out = "SELECT " + ", ".join([*[f"{sql} AS `{n}`" for n, sql in groups], f"{value} AS `{request.metric['name']}`"]) + f"\nFROM {place(request.base)}"
    for r in request.joins:
        out += f"\nLEFT JOIN {place(r['to']['table'])} ON {_on(request, r)}"
    if last:
        where = [f"{_quoted(request.base, last)} = (SELECT max(`{last}`) FROM {place(request.base).rpartition(' AS ')[0]})", *where]
    if where:
        out += "\nWHERE " + " AND ".join(f"({w})" for w in where)
    if groups:
        out += "\nGROUP BY " + ", ".join(sql for _, sql in groups) + "\nORDER BY " + ", ".join(f"`{n}`" for n, _ in groups)
    return out


def run_sql(spark: SparkSession, source, doc: dict, sql: str) -> DataFrame:
    """Run compiled SQL text against a source: its tables become views of the same names."""
    for t in doc["tables"]:
        name = t.get("source") or t["name"]
        if "." not in name:
            source.df(name).createOrReplaceTempView(name)
    return spark.sql(sql)
