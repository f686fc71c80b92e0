"""Decodes, calendars, freshness, metrics, aggregate tables with their hidden filters, domains and routing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.names import has
from ..functions.types import is_integer, is_temporal
from ..operators import aggregates as A
from .link import Stats

# Fixed values.
LABEL_SUFFIXES = ("_desc", "_nm", "_name", "_label")
DECODE_ROWS, DECODE_COLUMNS = 100, 3
RETIRED = re.compile(r"^(.*?)_(legacy|old|bak|deprecated|archive)$")
#: Groups from which an aggregate table is not verified.
GROUPS = 50_000
COMPLETED = ("complete", "closed", "success", "paid")
SNAPSHOTS = ("snap_dt", "snapshot_dt", "as_of_dt")
AGGREGATE_NAME = re.compile(r"(?:^|_)(?:agg|summary|rollup)(?:_|$)|^(?:dly|mth|wkly)_")


def _column(t: dict, name: str) -> dict | None:
    return next((c for c in t["columns"] if c["name"] == name), None)


def _active(doc: dict) -> list[dict]:
    return [t for t in doc["tables"] if t.get("lifecycle") not in ("deprecated", "orphaned")]


def decodes(doc: dict, stats: Stats, source) -> int:
    """Codes that refer to a small table with a label get their meanings from it."""
    tables, n = {t["name"]: t for t in doc["tables"]}, 0
    for r in doc.get("relationships", []):
        dim, key = tables[r["to"]["table"]], r["to"]["columns"][0]
        rows = next(iter(stats[dim["name"]].values())).row_count
        labels = [c["name"] for c in dim["columns"] if c["name"] != key and c["sql_type"].startswith("VARCHAR")]
        if rows > DECODE_ROWS or len(dim["columns"]) > DECODE_COLUMNS or not labels:
            continue
        label = min(labels, key=lambda c: not c.lower().endswith(LABEL_SUFFIXES))
        pairs = sorted((str(v), str(m)) for v, m in source.df(dim["name"]).select(key, label).limit(DECODE_ROWS + 1).collect())
        for t, c in ((r["from"]["table"], r["from"]["columns"][0]), (dim["name"], key)):
            _column(tables[t], c)["enum_values"] = [{"value": v, "meaning": m, "decode_source": "dictionary_join"} for v, m in pairs]
            n += 1
    return n


def deprecation(doc: dict) -> None:
    names = [t["name"] for t in doc["tables"]]
    for t in doc["tables"]:
        m = RETIRED.match(t["name"])
        if m:
            other = m[1] if m[1] in names else next((n for n in names if n.startswith(m[1]) and n != t["name"]), None)
            t |= {"lifecycle": "deprecated", "deprecation": {"replacement": other, "reason": f"name ends in {m[2]}"}}


def freshness(doc: dict, stats: Stats, source) -> None:
    for t in _active(doc):
        dates = [c["name"] for c in t["columns"] if is_temporal(stats[t["name"]][c["name"]].kind)]
        if dates and next(iter(stats[t["name"]].values())).row_count:
            on = max(dates, key=lambda c: stats[t["name"]][c].n_distinct)
            row = A.freshness(source.df(t["name"]), on).first()
            t["freshness"] = {"expected_cadence": row["cadence"], "inferred_from": f"{t['name']}.{on}"}


def time_attributes(doc: dict, stats: Stats, source) -> None:
    """Which integer columns of a calendar table are quarters, months and years, and which of them fiscal."""
    for t in doc["tables"]:
        own = stats[t["name"]]
        date = next((c["name"] for c in t["columns"] if is_temporal(own[c["name"]].kind) and own[c["name"]].is_unique), None)
        numbers = [c for c, s in own.items() if is_integer(s.kind) and not s.is_unique and s.n_distinct]
        if not date or not numbers:
            continue
        for r in A.time_attributes(source.df(t["name"]), date, numbers).collect():
            values, n = own[r["column"]].n_distinct, max(r["n"], 1)
            kind = None
            if 2 <= values <= 4 and r["low"] >= 1 and r["high"] <= 4:
                kind = "calendar_quarter" if r["quarter_hits"] == n else "fiscal_quarter" if r["quarter_hits"] < 0.9 * n else None
            elif 12 <= values <= 13 and r["low"] >= 1 and r["high"] <= 13:
                kind = "calendar_month" if r["month_hits"] == n else "fiscal_period" if r["month_hits"] < 0.9 * n else None
            elif r["year_off"] is not None and r["year_off"] <= 1 and r["high"] > 1900:
                kind = "calendar_year" if r["year_hits"] == n else "fiscal_year"
            if kind:
                _column(t, r["column"])["time_attribute"] = kind


def _time_dimension(doc: dict, t: dict) -> str | None:
    """An own date before an own timestamp, never an audit column; else the date of a table that this one refers to."""
    own = [c for c in t["columns"] if c["entity_role"] != "metadata"]
    for kind in ("DATE", "TIMESTAMP"):
        if found := next((c for c in own if c["sql_type"] == kind), None):
            return f"{t['name']}.{found['name']}"
    tables = {x["name"]: x for x in doc["tables"]}
    for r in doc.get("relationships", []):
        if r["from"]["table"] == t["name"]:
            other = tables[r["to"]["table"]]
            if any(c.get("time_attribute") for c in other["columns"]) and (d := next((c for c in other["columns"] if c["sql_type"] == "DATE"), None)):
                return f"{other['name']}.{d['name']}"
    return None


def metrics(doc: dict) -> None:
    """Totals of money, their completed variants where a status is decoded, and counts of facts."""
    out = doc.setdefault("metrics", [])
    taken = {m["name"] for m in out}

    def put(name: str, **kw) -> None:
        if name not in taken:
            taken.add(name)
            out.append({"name": name, "type": "simple", "lifecycle": "inferred", "provenance": [{"signal": "statistic", "detail": "candidate"}]} | kw)

    for t in _active(doc):
        if t["table_type"] not in ("fact", "aggregate", "unknown"):
            continue
        time = _time_dimension(doc, t)
        extra = {"agg_time_dimension": time} if time else {}
        done = None
        for c in t["columns"]:
            good = [v["value"] for v in c.get("enum_values", []) if v.get("decode_source") in ("dictionary_join", "docs", "human") and any(w in str(v.get("meaning", "")).lower() for w in COMPLETED)]
            if good and c["semantic_type"] == "status_code" and done is None:
                done = f"{c['name']} IN ({', '.join(chr(39) + str(v).replace(chr(39), chr(39) * 2) + chr(39) for v in good)})"
        for c in t["columns"]:
            if c["entity_role"] == "measure" and c["semantic_type"] == "monetary_value":
                name = f"total_{c['name']}" if f"total_{c['name']}" not in taken else f"total_{t['name']}_{c['name']}"
                put(name, measure=f"{t['name']}.{c['name']}", agg="sum", confidence=round(min(0.85, c["confidence"]), 2), **extra)
                if done and t["table_type"] == "fact":
                    put(f"{name}_completed", measure=f"{t['name']}.{c['name']}", agg="sum", filter=done, confidence=0.6, **extra)
        if t["table_type"] == "fact" and t["primary_key"]:
            put(f"{t['name']}_count", measure=f"{t['name']}.{t['primary_key'][0]}", agg="count", confidence=0.8, **extra)


def aggregate_tables(doc: dict, stats: Stats, source) -> None:
    """Aggregate tables that reconcile with a fact, group by group; a filter that makes them do so is a business rule.

    A grouping is a column of the same name in both, or a date key against a date. For a grouping by equal keys a fact
    is read once for all hypotheses about a status; sums that are paired by rank take a read each. Aggregate tables of
    GROUPS groups or more stay unverified. Nothing is routed: the status stays advisory."""
    out = doc.setdefault("aggregate_tables", [])
    facts = [t for t in _active(doc) if t["table_type"] == "fact"]
    for agg in _active(doc):
        if agg["table_type"] != "aggregate" and not AGGREGATE_NAME.search(agg["name"].lower()):
            continue
        sums = [c["name"] for c in agg["columns"] if c["entity_role"] == "measure" and c["semantic_type"] == "monetary_value"]
        for fact in facts:
            found = next((x for a in sums for m in fact["columns"] if m["entity_role"] == "measure" and m["semantic_type"] == "monetary_value" for x in [_reconcile(agg, fact, a, m["name"], stats, source)] if x), None)
            if found:
                a, m, grain, rule = found
                entry = {"table": agg["name"], "aggregates": fact["name"], "grain": grain, "measure_mappings": [{"source": f"{fact['name']}.{m}", "target": f"{agg['name']}.{a}"}], "mapping_source": "heuristic", "routing": {"rule": "grain covers the request", "status": "advisory"}, "consistency": {"method": "per_group", "status": "verified", "filter": rule}}
                out.append(entry)
                if rule:
                    _scope(doc, fact, rule)
                break


def _groupings(agg: dict, fact: dict, stats: Stats) -> list[tuple[str, str, bool]]:
    """(aggregate column, fact column, by rank)."""
    mine = {c["name"] for c in agg["columns"] if c["entity_role"] != "measure"}
    theirs = {c["name"] for c in fact["columns"] if c["entity_role"] != "measure"}
    out = [(c, c, False) for c in sorted(mine & theirs)]
    keys = [c for c in mine - theirs if has(c, "dt", "date") and is_integer(stats[agg["name"]][c].kind)]
    dates = [c for c in theirs if is_temporal(stats[fact["name"]][c].kind) and _column(fact, c)["entity_role"] != "metadata"]
    return out + [(k, d, True) for k in sorted(keys) for d in sorted(dates)[:1]]


def _reconcile(agg: dict, fact: dict, a: str, m: str, stats: Stats, source) -> tuple | None:
    groups = _groupings(agg, fact, stats)
    if not groups:
        return None
    status = [(c["name"], [str(v["value"]) for v in c.get("enum_values", [])][: A.STATUSES]) for c in fact["columns"] if c["semantic_type"] == "status_code"]
    status = [(c, [str(v) for v, _ in stats[fact["name"]][c].top_values][: A.STATUSES] or v) for c, v in status]
    left, right = source.df(agg["name"]), source.df(fact["name"])
    fits: dict[str | None, bool] = {}
    for x, y, ranked in groups:
        mine = A.group_sums(left, x, a)
        if mine.limit(GROUPS).count() >= GROUPS:
            return None  # too many groups to verify
        if ranked:
            theirs = right.withColumn(y, F.to_date(y))
            for rule in [None, *[(c, v) for c, values in status for v in values]]:
                if fits.get(rule, True):
                    row = A.match_by_rank(mine, A.group_sums(theirs, y, m, None if rule is None else F.col(rule[0]) != rule[1])).first()
                    fits[rule] = row["n_groups"] > 0 and row["n_matched"] >= A.COVERED * row["n_groups"]
        else:  # all values of a status in one pass over the fact
            for c, values in status or [(None, [])]:
                for row in A.hypotheses(mine, right, x, m, c or y, values, y).collect():
                    rule = None if row["excluded"] is None else (c, row["excluded"])
                    good = row["n_groups"] > 0 and row["n_matched"] >= A.COVERED * row["n_groups"]
                    fits[rule] = fits.get(rule, True) and good
    if fits.get(None):
        return a, m, [x for x, _, _ in groups], None
    found = next(((c, v) for c, values in status for v in values if fits.get((c, v))), None)
    return (a, m, [x for x, _, _ in groups], f"{found[0]} <> '{found[1]}'") if found else None


def _scope(doc: dict, fact: dict, rule: str) -> None:
    """The rule goes to sums and averages of the fact that have no filter yet, never to counts, and into a note."""
    for m in doc.get("metrics", []):
        if m.get("measure", "").startswith(f"{fact['name']}.") and m.get("agg") in ("sum", "avg") and not m.get("filter"):
            m["filter"] = rule
            m["provenance"].append({"signal": "statistic", "detail": f"aggregate tables leave out what {rule} leaves out"})
    notes = fact.setdefault("knowledge", {}).setdefault("usage_notes", [])
    if rule not in " ".join(notes):
        notes.append(f"Reported totals apply {rule}.")


def domains(doc: dict) -> list[dict]:
    """Connected groups of two tables or more, named after their first fact."""
    up = {t["name"]: t["name"] for t in doc["tables"]}

    def top(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in doc.get("relationships", []):
        up[top(r["from"]["table"])] = top(r["to"]["table"])
    groups: dict[str, list[dict]] = {}
    for t in doc["tables"]:
        groups.setdefault(top(t["name"]), []).append(t)
    out = []
    for g in groups.values():
        if len(g) > 1:
            head = next((t for t in g if t.get("table_type") == "fact"), g[0])
            out.append({"name": head["name"], "tables": sorted(t["name"] for t in g), "description": f"{len(g)} tables around {head['name']}"})
    return out


def routing(doc: dict) -> None:
    """For each fact in use: ask it, and not the retired or staged tables that are named like it."""
    know = doc.setdefault("repo_knowledge", {})
    know["domains"] = domains(doc)
    know["routing"] = []
    for t in _active(doc):
        if t["table_type"] == "fact":
            avoid = [{"table": o["name"], "reason": o.get("deprecation", {}).get("reason", o["table_type"])} for o in doc["tables"] if o["name"] != t["name"] and o["name"][:6] == t["name"][:6] and (o.get("lifecycle") == "deprecated" or o["table_type"] in ("staging", "aggregate"))]
            know["routing"].append({"intent": f"questions about {t['name'].replace('_', ' ')}", "use": [t["name"]], "avoid": avoid})


def snapshot_filters(doc: dict) -> None:
    for t in doc["tables"]:
        on = next((c["name"] for c in t["columns"] if c["name"].lower() in SNAPSHOTS), None)
        if on and t["table_type"] == "snapshot_scd2":
            known = t.setdefault("knowledge", {}).setdefault("required_filters", [])
            known.append({"expr": f"{on} = (SELECT max({on}) FROM {t['name']})", "enforcement": "advisory", "reason": "one row a key and snapshot"})


def enrich(doc: dict, stats: Stats, source) -> None:
    decodes(doc, stats, source)
    deprecation(doc)
    freshness(doc, stats, source)
    time_attributes(doc, stats, source)
    metrics(doc)
    aggregate_tables(doc, stats, source)
    routing(doc)
    snapshot_filters(doc)
