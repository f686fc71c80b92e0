"""A document in the form that dbt's semantic layer reads, with a list of what gets lost, and read-only grants."""

from __future__ import annotations

# Names of aggregations there.
AGGS = {"sum": "sum", "avg": "average", "min": "min", "max": "max", "count": "count", "count_distinct": "count_distinct", "median": "median", "percentile": "percentile"}
KEYS = {"unique_key": "unique", "foreign_key": "foreign", "natural_key": "natural"}
TIMES = ("date", "timestamp_event", "timestamp_effective")


def export_dbt(doc: dict) -> tuple[dict, list[str]]:
    losses, models, metrics = [], [], []
    measures = {m["measure"]: m for m in doc.get("metrics", []) if m.get("type", "simple") == "simple"}
    for t in doc["tables"]:
        if t.get("lifecycle") in ("deprecated", "orphaned"):
            losses.append(f"{t['name']}: left out, {t['lifecycle']}")
            continue
        model: dict = {"name": t["name"], "model": f"ref('{t['name']}')", "entities": [], "dimensions": [], "measures": []}
        for c in t["columns"]:
            at = f"{t['name']}.{c['name']}"
            about = {"description": c["description"]} if c.get("description") else {}
            if c["name"] in t.get("primary_key", []) or c["entity_role"] in KEYS:
                kind = "primary" if c["name"] in t.get("primary_key", []) else KEYS[c["entity_role"]]
                model["entities"].append({"name": c["name"], "type": kind, "expr": c["name"]})
            elif c["entity_role"] == "measure":
                model["measures"].append({"name": c["name"], "agg": AGGS.get(c.get("aggregations", {}).get("default", "sum"), "sum"), "expr": c["name"]} | about)
            else:
                time = c["sql_type"] in ("DATE", "TIMESTAMP") or c.get("semantic_type") in TIMES
                model["dimensions"].append(({"name": c["name"], "type": "time", "type_params": {"time_granularity": "day"}} if time else {"name": c["name"], "type": "categorical"}) | about)
            if at in measures and c["entity_role"] != "measure":
                model["measures"].append({"name": f"{c['name']}_{measures[at].get('agg', 'count')}", "agg": AGGS.get(measures[at].get("agg", "count"), "count"), "expr": c["name"]})
            losses += [f"{at}: {k} has no place" for k in ("enum_values", "conflicts", "confidence", "pii") if c.get(k)]
        clock = next((d["name"] for d in model["dimensions"] if d["type"] == "time"), None)
        if clock:
            model["defaults"] = {"agg_time_dimension": clock}
        if t.get("description"):
            model["description"] = t["description"]
        model["meta"] = {"table_type": t.get("table_type", "unknown"), "lifecycle": t.get("lifecycle", "inferred")}
        losses += [f"{t['name']}: {k} has no place" for k in ("knowledge", "scd", "freshness") if t.get(k)]
        models.append(model)
    for m in doc.get("metrics", []):
        kind = m.get("type", "simple")
        if kind not in ("simple", "ratio"):
            losses.append(f"metric {m['name']}: left out, {kind}")
            continue
        params = {k: m[k].rpartition(".")[2] for k in (("measure",) if kind == "simple" else ("numerator", "denominator"))}
        metrics.append({"name": m["name"], "type": kind, "label": m.get("display_name", m["name"]), "type_params": params} | ({"filter": m["filter"]} if m.get("filter") else {}))
    losses += [f"hierarchy {h.get('name', h.get('dimension_table'))}: has no place" for h in doc.get("hierarchies", [])]
    losses += [f"aggregate {a['table']}: has no place" for a in doc.get("aggregate_tables", [])]
    losses += ["repo_knowledge has no place"] if doc.get("repo_knowledge") else []
    return {"semantic_models": models, "metrics": metrics}, losses


def grants(kind: str, **names: str) -> str:
    """Statements that give a reader, and nobody else, the right to read."""
    if kind == "snowflake":
        who, where = names.get("role", "SEMANTIC_READER"), names["database"]
        rights = [f"USAGE ON DATABASE {where}", f"USAGE ON ALL SCHEMAS IN DATABASE {where}", f"SELECT ON ALL TABLES IN DATABASE {where}", f"SELECT ON FUTURE TABLES IN DATABASE {where}"]
        return "\n".join([f"CREATE ROLE IF NOT EXISTS {who};", *[f"GRANT {r} TO ROLE {who};" for r in rights]])
    if kind == "bigquery":
        who = f"serviceAccount:{names['account']}"
        return "\n".join(f"gcloud projects add-iam-policy-binding {names['project']} --member={who} --role=roles/bigquery.{r}" for r in ("dataViewer", "jobUser"))
    if kind == "catalog":
        return f"GRANT USAGE, SELECT ON DATABASE {names['database']} TO `{names['principal']}`;"
    raise ValueError(f"no grants for {kind!r}")
