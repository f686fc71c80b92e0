"""Drift of a warehouse against its document: events, blast radius, and what becomes of the elements that are hit."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import SparkSession

from ..operators.drift import stale, unknown_values

DEPTH = 3


@dataclass(frozen=True)
class Event:
    kind: str
    table: str
    column: str | None = None
    detail: str = ""

    @property
    def element(self) -> str:
        return f"{self.table}.{self.column}" if self.column else self.table


@dataclass
class Changeset:
    events: list[Event] = field(default_factory=list)
    radius: dict[str, int] = field(default_factory=dict)
    orphaned: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)
    failing: list[str] = field(default_factory=list)


def baseline(doc: dict) -> dict[str, dict[str, str]]:
    """{table: {column: type}} that the document still counts on."""
    return {t.get("source") or t["name"]: {c["name"]: c["sql_type"] for c in t["columns"] if c.get("lifecycle") != "orphaned"} for t in doc["tables"] if t.get("lifecycle") != "orphaned"}


def diff(before: dict[str, dict[str, str]], after: dict[str, dict[str, str]]) -> list[Event]:
    out = [Event("table_dropped", t) for t in before.keys() - after.keys()] + [Event("table_added", t) for t in after.keys() - before.keys()]
    for t in before.keys() & after.keys():
        a, b = before[t], after[t]
        out += [Event("column_dropped", t, c) for c in a.keys() - b.keys()] + [Event("column_added", t, c, b[c]) for c in b.keys() - a.keys()]
        out += [Event("column_retyped", t, c, f"{a[c]} -> {b[c]}") for c in a.keys() & b.keys() if a[c] != b[c]]
    return sorted(out, key=lambda e: (e.table, e.column or "", e.kind))


def semantic(doc: dict, source, live: dict[str, dict[str, str]], today: date | None = None) -> list[Event]:
    """Values that the document doesn't name, and loads that are late."""
    out = []
    for t in doc["tables"]:
        place = t.get("source") or t["name"]
        if place not in live or t.get("lifecycle") == "orphaned":
            continue
        for c in t["columns"]:
            if c.get("enum_values") and c["name"] in live[place]:
                found = sorted(r["value"] for r in unknown_values(source.df(place), c["name"], [str(v["value"]) for v in c["enum_values"]]).collect())
                if found:
                    out.append(Event("enum_drift", t["name"], c["name"], ", ".join(found)))
        fresh = t.get("freshness", {})
        if today and fresh.get("inferred_from") and fresh["inferred_from"].rpartition(".")[2] in live[place]:
            row = stale(source.df(place), fresh["inferred_from"].rpartition(".")[2], fresh["expected_cadence"], today).first()
            if row["is_stale"]:
                out.append(Event("table_stale", t["name"], None, f"last load {row['last_date']}"))
    return out


def _uses(doc: dict) -> list[tuple[str, str]]:
    """(user, used) pairs of elements."""
    out = []
    for t in doc["tables"]:
        for c in t["columns"]:
            if ref := c.get("foreign_key", {}).get("references"):
                out.append((f"{t['name']}.{c['name']}", ref))
    for r in doc.get("relationships", []):
        for side in ("from", "to"):
            out += [(f"relationship:{r['name']}", f"{r[side]['table']}.{c}") for c in r[side]["columns"]]
    for m in doc.get("metrics", []):
        used = [m.get(k) for k in ("measure", "numerator", "denominator", "agg_time_dimension")] + m.get("input_metrics", [])
        out += [(f"metric:{m['name']}", u if "." in u else f"metric:{u}") for u in used if u]
        base = (m.get("measure") or m.get("numerator") or "").partition(".")[0]
        out += [(f"metric:{m['name']}", f"{base}.{c['name']}") for t in doc["tables"] if t["name"] == base for c in t["columns"] if c["name"] in (m.get("filter") or "")]
    for a in doc.get("aggregate_tables", []):
        out += [(f"aggregate:{a['table']}", a["aggregates"])] + [(f"aggregate:{a['table']}", m["source"]) for m in a.get("measure_mappings", [])]
    return out


def blast_radius(doc: dict, element: str, depth: int = DEPTH) -> dict[str, int]:
    """Everything that uses ``element``, directly or through others, and in how many steps."""
    uses, hit, edge = _uses(doc), {}, {element}
    for n in range(1, depth + 1):
        edge = {user for user, used in uses if user not in hit and user != element and any(used == e or used.startswith(f"{e}.") for e in edge)}
        if not edge:
            break
        hit |= dict.fromkeys(edge, n)
    return hit


def apply(doc: dict, events: list[Event]) -> Changeset:
    """Dropped elements become orphaned, never deleted, and take their metrics and relationships along. A new type under
    a reviewed element is a conflict, as are unknown values; added elements wait for inference."""
    out = Changeset(list(events))
    tables = {t.get("source") or t["name"]: t for t in doc["tables"]} | {t["name"]: t for t in doc["tables"]}
    for e in events:
        t = tables.get(e.table)
        if t is None:
            continue
        e = Event(e.kind, t["name"], e.column, e.detail)
        out.radius |= blast_radius(doc, e.element)
        c = next((c for c in t["columns"] if c["name"] == e.column), None)
        if e.kind in ("table_dropped", "column_dropped"):
            for x in [c] if c else [t, *t["columns"]]:
                x["lifecycle"] = "orphaned"
            out.orphaned.append(e.element)
            gone = {f"metric:{m['name']}": m for m in doc.get("metrics", [])} | {f"relationship:{r['name']}": r for r in doc.get("relationships", [])}
            for name, n in blast_radius(doc, e.element).items():
                if name in gone and (n == 1 or name.startswith("metric:")):
                    gone[name]["lifecycle"] = "orphaned"
                    out.orphaned.append(name)
        elif e.kind == "column_added":
            t["columns"].append({"name": e.column, "sql_type": e.detail, "semantic_type": "unknown", "entity_role": "dimension", "confidence": 0.0, "lifecycle": "inferred", "needs_inference": True, "provenance": []})
        elif c is not None:
            if e.kind == "enum_drift" or (e.kind == "column_retyped" and c.get("lifecycle") in ("reviewed", "certified")):
                c.setdefault("conflicts", []).append({"between": ["document", "warehouse"], "detail": f"{e.kind}: {e.detail}"})
                out.conflicts.append(e.element)
            if e.kind == "column_retyped":
                c["sql_type"] = e.detail.rpartition(" -> ")[2]
    return out


def regressions(spark: SparkSession, questions: list[dict], radius: dict[str, int]) -> list[str]:
    """Questions whose SQL no longer passes analysis, or that name an element in the radius. Nothing is run."""
    out = []
    for q in questions:
        sql = (q.get("expected_sql") or {}).get("spark") or next(iter((q.get("expected_sql") or {}).values()), None)
        if sql:
            try:
                spark.sql(sql).schema
            except Exception:  # any failure of analysis counts
                out.append(q["id"])
                continue
        if any(r in radius for r in q.get("references", [])):
            out.append(q["id"])
    return out


def render(change: Changeset) -> str:
    if not change.events:
        return "# Drift\n\nNone.\n"
    lines = ["# Drift", "", *[f"- {e.kind}: `{e.element}`" + (f" ({e.detail})" if e.detail else "") for e in change.events]]
    for title, items in (("Blast radius", [f"`{k}` ({n})" for k, n in sorted(change.radius.items())]), ("Orphaned", [f"`{x}`" for x in change.orphaned]), ("Conflicts", [f"`{x}`" for x in change.conflicts]), ("Questions", change.failing)):
        if items:
            lines += ["", f"## {title}", "", *[f"- {x}" for x in items]]
    return "\n".join(lines) + "\n"
