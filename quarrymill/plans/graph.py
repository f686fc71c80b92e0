"""The document as a graph: nodes, edges, entity groups and join paths."""

from __future__ import annotations

from collections import deque

HOPS = 4


def base_graph(doc: dict) -> dict:
    """{nodes, edges, entities}: tables, typed edges, and columns that name one entity."""
    nodes = [{"id": t["name"], "type": t.get("table_type", "unknown"), "lifecycle": t.get("lifecycle", "")} for t in doc["tables"]]
    edges = [{"kind": "references", "from": r["from"]["table"], "to": r["to"]["table"], "on": list(zip(r["from"]["columns"], r["to"]["columns"], strict=True))} for r in doc.get("relationships", [])]
    edges += [{"kind": "recursive", "from": h["dimension_table"], "to": h["dimension_table"], "on": [(h["recursive"]["parent_column"], h["recursive"]["child_column"])]} for h in doc.get("hierarchies", []) if h["kind"] == "recursive"]
    edges += [{"kind": "aggregates", "from": a["table"], "to": a["aggregates"], "on": []} for a in doc.get("aggregate_tables", [])]
    entities: dict[str, list[str]] = {}
    for t in doc["tables"]:
        for c in t["columns"]:
            target = c.get("canonical_entity") or c.get("foreign_key", {}).get("references")
            if target:
                entities.setdefault(target, []).append(f"{t['name']}.{c['name']}")
    return {"nodes": nodes, "edges": edges, "entities": entities}


def join_path(doc: dict, start: str, end: str, hops: int = HOPS) -> list[str] | None:
    """Table names along the shortest path over references in either direction."""
    near: dict[str, list[str]] = {}
    for e in base_graph(doc)["edges"]:
        if e["kind"] == "references":
            near.setdefault(e["from"], []).append(e["to"])
            near.setdefault(e["to"], []).append(e["from"])
    paths, todo = {start: [start]}, deque([start])
    while todo:
        at = todo.popleft()
        if at == end:
            return paths[at]
        if len(paths[at]) > hops:
            continue
        for to in near.get(at, []):
            if to not in paths:
                paths[to] = [*paths[at], to]
                todo.append(to)
    return None
