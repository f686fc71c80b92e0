"""Whether a document is well formed and refers only to what it holds."""

from __future__ import annotations

from .describe import TABLE_TYPES
from .typing import ROLES, SEMANTIC_TYPES

# Fixed values.
ROOT = "spec_version name generated_by tables relationships hierarchies aggregate_tables metrics repo_knowledge description ai_context calendar".split()
NEEDED = ("spec_version", "name", "tables")
LIFECYCLES = ("inferred", "reviewed", "certified", "deprecated", "orphaned")
SOURCES = ("llm_guess", "dictionary_join", "docs", "human")
METRIC_TYPES = ("simple", "ratio", "derived")
HIERARCHIES = ("level", "time", "recursive")


def validate(doc: dict) -> list[str]:
    """Errors, none if all is well."""
    out = [f"unknown key {k!r}" for k in doc if k not in ROOT] + [f"missing key {k!r}" for k in NEEDED if k not in doc]
    if any(k not in doc for k in NEEDED) or not isinstance(doc["tables"], list):
        return out
    columns: dict[str, dict[str, dict]] = {}
    for t in doc["tables"]:
        name = t.get("name")
        if not name:
            out.append("a table without a name")
            continue
        if name in columns:
            out.append(f"table {name!r} twice")
        columns[name] = {c.get("name", ""): c for c in t.get("columns", [])}
        if len(columns[name]) != len(t.get("columns", [])):
            out.append(f"{name}: a column twice")
        out += [f"{name}: unknown table_type {t.get('table_type')!r}"] * (t.get("table_type", "unknown") not in TABLE_TYPES)
        out += [f"{name}: primary key {k!r} is no column" for k in t.get("primary_key", []) if k not in columns[name]]
        out += _common(name, t)
        for c in t.get("columns", []):
            at = f"{name}.{c.get('name')}"
            out += [f"{at}: unknown semantic_type {c.get('semantic_type')!r}"] * (c.get("semantic_type", "unknown") not in SEMANTIC_TYPES)
            out += [f"{at}: unknown entity_role {c.get('entity_role')!r}"] * (c.get("entity_role", "dimension") not in ROLES)
            out += [f"{at}: unknown decode_source {v['decode_source']!r}" for v in c.get("enum_values", []) if v.get("decode_source", "human") not in SOURCES]
            out += _common(at, c)

    def known(name: str | None) -> bool:
        t, _, c = (name or "").rpartition(".")
        return t in columns and c in columns[t]

    for t in doc["tables"]:
        for c in t.get("columns", []):
            ref = c.get("foreign_key", {}).get("references")
            out += [f"{t['name']}.{c['name']}: refers to unknown {ref!r}"] * bool(ref and not known(ref))
        other = t.get("deprecation", {}).get("replacement")
        out += [f"{t['name']}: replacement {other!r} is no table"] * bool(other and other not in columns)
        for k in ("valid_from", "valid_to", "is_current_flag"):
            v = t.get("scd", {}).get(k)
            out += [f"{t['name']}: scd {k} {v!r} is no column"] * bool(v and v not in columns[t["name"]])
    for r in doc.get("relationships", []):
        for side in ("from", "to"):
            out += [f"relationship {r.get('name')}: unknown {r[side]['table']}.{c}" for c in r[side]["columns"] if not known(f"{r[side]['table']}.{c}")]
        out += [f"relationship {r.get('name')}: sides differ in length"] * (len(r["from"]["columns"]) != len(r["to"]["columns"]))
        on = r.get("asof", {}).get("on")
        out += [f"relationship {r.get('name')}: asof on unknown {on!r}"] * bool(on and not known(on if "." in on else f"{r['from']['table']}.{on}"))
    for h in doc.get("hierarchies", []):
        t = h.get("dimension_table")
        at = f"hierarchy {h.get('name', t)}"
        out += [f"{at}: unknown kind {h.get('kind')!r}"] * (h.get("kind") not in HIERARCHIES) + [f"{at}: unknown table {t!r}"] * (t not in columns)
        names = list(h.get("recursive", {}).values()) + [x["column"] for x in h.get("levels", []) if x.get("column")]
        out += [f"{at}: unknown column {c!r}" for c in names if t in columns and c not in columns[t]]
        levels = {x["name"] for x in h.get("levels", [])}
        out += [f"{at}: alias of unknown level {v!r}" for v in h.get("level_aliases", {}).values() if v not in levels]
    for a in doc.get("aggregate_tables", []):
        out += [f"aggregate {a.get('table')}: unknown table {x!r}" for x in (a.get("table"), a.get("aggregates")) if x not in columns]
        out += [f"aggregate {a.get('table')}: unknown {x!r}" for m in a.get("measure_mappings", []) for x in (m["source"], m["target"]) if not known(x)]
    names = {m.get("name") for m in doc.get("metrics", [])}
    out += [f"metric {n!r} twice" for n in names if sum(m.get("name") == n for m in doc.get("metrics", [])) > 1]
    for m in doc.get("metrics", []):
        at, kind = f"metric {m.get('name')}", m.get("type", "simple")
        out += [f"{at}: unknown type {kind!r}"] * (kind not in METRIC_TYPES) + _common(at, m)
        used = [m.get("measure")] if kind == "simple" else [m.get("numerator"), m.get("denominator")] if kind == "ratio" else m.get("input_metrics", [None])
        for u in used:  # both a column and the name of a metric will do, but for simple metrics
            if not (known(u) or (kind != "simple" and u in names)):
                out.append(f"{at}: unknown {u!r}")
        time = m.get("agg_time_dimension")
        out += [f"{at}: unknown time dimension {time!r}"] * bool(time and not known(time))
    for r in doc.get("repo_knowledge", {}).get("routing", []):
        out += [f"routing {r.get('intent')!r}: unknown table {x!r}" for x in [*r.get("use", []), *[a["table"] for a in r.get("avoid", [])]] if x not in columns]
    return out


def _common(at: str, x: dict) -> list[str]:
    out = [f"{at}: unknown lifecycle {x.get('lifecycle')!r}"] * (x.get("lifecycle", "inferred") not in LIFECYCLES)
    sure = x.get("confidence")
    return out + [f"{at}: confidence {sure!r} is not in 0 to 1"] * (sure is not None and not (isinstance(sure, (int, float)) and 0 <= sure <= 1))
