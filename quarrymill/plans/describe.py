"""Descriptions of tables by a language model, in two passes: the second sees what the neighbours are."""

from __future__ import annotations

import json

# Fixed values.
TABLE_TYPES = ("fact", "dimension", "aggregate", "denormalized", "staging", "operational", "snapshot_scd2", "unknown")


def describe(doc: dict, stats, provider) -> int:
    tables, n = {t["name"]: t for t in doc["tables"]}, 0
    near: dict[str, set[str]] = {t: set() for t in tables}
    for r in doc.get("relationships", []):
        near[r["from"]["table"]].add(r["to"]["table"])
        near[r["to"]["table"]].add(r["from"]["table"])
    for second in (False, True):
        for name, t in tables.items():
            facts: dict = {"table": name, "rows": next((s.row_count for s in stats[name].values()), 0), "columns": [{"name": c["name"], "type": c["semantic_type"]} for c in t["columns"]]}
            if second:
                if not near[name]:
                    continue
                facts["neighbours"] = {x: tables[x].get("description", "") for x in sorted(near[name])}
            answer = provider.json("Describe a warehouse table. JSON object {description, table_type, columns: {name: description}}.", json.dumps(facts))
            if not isinstance(answer, dict):
                continue
            n += 1
            t["description"] = str(answer.get("description", t.get("description", "")))
            if t["table_type"] == "unknown" and answer.get("table_type") in TABLE_TYPES:
                t["table_type"] = answer["table_type"]
            for c in t["columns"]:
                said = (answer.get("columns") or {}).get(c["name"])
                if said and not c.get("description"):
                    c["description"] = str(said)
    return n
