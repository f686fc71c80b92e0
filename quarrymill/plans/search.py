"""What an agent asks a document: lists, single tables, search, routing, metrics. All answers are plain data."""

from __future__ import annotations

import re

from .compile import Compiled, compile_metric
from .graph import join_path

UNUSABLE = ("deprecated", "orphaned")
TOP, ROUTES = 10, 5


def list_tables(doc: dict, domain: str | None = None) -> list[dict]:
    inside = next((d["tables"] for d in list_domains(doc) if d["name"] == domain), None) if domain else None
    out = []
    for t in doc["tables"]:
        if inside is None or t["name"] in inside:
            row = {"name": t["name"], "type": t.get("table_type", "unknown"), "description": t.get("description", ""), "columns": len(t["columns"])}
            if t.get("lifecycle") in UNUSABLE:
                row |= {"status": "UNUSABLE", "use_instead": t.get("deprecation", {}).get("replacement")}
            out.append(row)
    return out


def list_domains(doc: dict) -> list[dict]:
    return doc.get("repo_knowledge", {}).get("domains", [])


def get_table(doc: dict, name: str) -> dict:
    t = next((t for t in doc["tables"] if t["name"] == name), None)
    if t is None:
        return {"error": f"unknown table {name!r}", "tables": [x["name"] for x in doc["tables"]]}
    keys = ("name", "sql_type", "semantic_type", "entity_role", "description", "enum_values", "foreign_key", "pii")
    return {
        "name": name, "type": t.get("table_type"), "description": t.get("description", ""), "primary_key": t.get("primary_key", []), "columns": [{k: c[k] for k in keys if k in c} for c in t["columns"]],
        "required_filters": t.get("knowledge", {}).get("required_filters", []), "usage_notes": t.get("knowledge", {}).get("usage_notes", []),
        "relationships": [r for r in doc.get("relationships", []) if name in (r["from"]["table"], r["to"]["table"])],
    } | ({"status": "UNUSABLE", "use_instead": t.get("deprecation", {}).get("replacement")} if t.get("lifecycle") in UNUSABLE else {})


def search(doc: dict, text: str) -> list[dict]:
    """Keywords as substrings: a hit in a name counts two, a hit in the text, name included, one; a hit in the text of a
    metric counts two, with one more for being a metric. Equal scores keep the order of the document."""
    words = [w for w in re.split(r"\W+", text.lower()) if w]

    def hits(*texts: str | None) -> int:
        joined = " ".join(t or "" for t in texts).lower()
        return sum(w in joined for w in words)

    found = []
    for t in doc["tables"]:
        about = t.get("description") or ""
        found.append(({"kind": "table", "name": t["name"], "description": about[:100], "lifecycle": t.get("lifecycle", "inferred")}, 2 * hits(t["name"]) + hits(t["name"], about, t.get("ai_context"))))
        for c in t["columns"]:
            about = c.get("description") or ""
            found.append(({"kind": "column", "name": f"{t['name']}.{c['name']}", "semantic_type": c.get("semantic_type"), "description": about[:80]}, 2 * hits(c["name"]) + hits(c["name"], about)))
    for m in doc.get("metrics", []):
        n = 2 * hits(m["name"], m.get("display_name"), *m.get("synonyms", []))
        found.append(({"kind": "metric", "name": m["name"], "measure": m.get("measure"), "filter": m.get("filter")}, n + 1 if n else 0))
    return [what | {"score": n} for what, n in sorted(found, key=lambda x: -x[1]) if n][:TOP]


def list_metrics(doc: dict) -> list[dict]:
    return [{k: m[k] for k in ("name", "type", "measure", "numerator", "denominator", "agg", "filter", "dimensions", "lifecycle", "confidence") if k in m} for m in doc.get("metrics", [])]


def routing(doc: dict, question: str) -> list[dict]:
    words = {w for w in re.split(r"\W+", question.lower()) if len(w) > 2}
    ranked = [(len(words & set(re.split(r"\W+", r["intent"].lower()))), r) for r in doc.get("repo_knowledge", {}).get("routing", [])]
    return [r for n, r in sorted(ranked, key=lambda x: -x[0]) if n][:ROUTES]


def tools(doc: dict) -> dict:
    """Functions by name for a tool server (a thin wrapper of any protocol makes them callable)."""

    def metric(name: str, group_by: str = "", time_grain: str = "", time_start: str = "", time_end: str = "", extra_filter: str = "", calendar: str = "", dialect: str = "spark") -> dict:
        split = [g.strip() for g in group_by.split(",") if g.strip()]
        out = compile_metric(doc, name, split or None, time_grain or None, time_start or None, time_end or None, extra_filter or None, calendar or None, dialect=dialect)
        return {"sql": out.sql, "warnings": out.warnings} if isinstance(out, Compiled) else {"refused": out.reason, "group_bys": out.group_bys, "grains": out.grains}

    return {
        "list_domains": lambda: list_domains(doc), "list_tables": lambda domain="": list_tables(doc, domain or None), "get_table": lambda name: get_table(doc, name), "search": lambda text: search(doc, text),
        "list_metrics": lambda: list_metrics(doc), "get_routing": lambda question: routing(doc, question), "compile_metric": metric, "join_path": lambda start, end: join_path(doc, start, end),
    }
