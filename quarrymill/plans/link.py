"""Foreign keys: candidates from names and statistics, one inclusion job, and a decision that needs more than numbers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.names import has, looks_like_key, similarity
from ..functions.types import family, is_numeric
from ..operators.joins import inclusion_matrix
from ..operators.profile import ColumnStats

# Fixed values.
LEAST_RATIO, PARENTS, TESTS, BATCH = 0.95, 200, 40, 30
ACCEPT, REVIEW_FLOOR = 0.6, 0.35
VALIDITY = ("eff_start_dt", "eff_end_dt", "valid_from", "valid_to")
RECURSIVE = ("mgr", "manager", "parent", "sup", "boss", "report", "referrer", "ref_by")
STAGING, OPS = ("stg", "staging", "raw", "tmp", "temp"), ("etl", "log", "audit", "job", "run", "batch")
AGGREGATE = ("agg", "summary", "rollup", "dly", "daily", "mth", "monthly", "wkly", "weekly")
DIMENSION, SNAPSHOT = ("dim", "ref", "mstr", "master", "lookup", "xref"), ("snpsht", "snapshot", "snap", "hist", "history")
#: Columns from which a table counts as denormalized.
WIDE = 50
MARKERS = ("snap_dt", "snapshot_dt", "is_current", "is_curr")

Stats = dict[str, dict[str, ColumnStats]]


@dataclass
class Candidate:
    child: tuple[str, str]
    parent: tuple[str, str]
    name_score: float
    ratio: float = 0.0
    child_distinct: int = 0
    parent_distinct: int = 0
    verdict: str | None = None


def _columns(doc: dict) -> dict[tuple[str, str], dict]:
    return {(t["name"], c["name"]): c for t in doc["tables"] for c in t["columns"]}


def has_validity(columns) -> bool:
    return any(c.lower() in VALIDITY or c.lower().endswith("_start_dt") for c in columns)


def _parents(doc: dict, stats: Stats) -> list[tuple[str, str]]:
    out = []
    for (t, c), column in _columns(doc).items():
        s = stats[t][c]
        key = column["entity_role"] in ("primary_key", "unique_key") or looks_like_key(c)
        versioned = has_validity(stats[t]) and looks_like_key(c) and s.n_distinct >= 20 and s.row_count <= 6 * s.n_distinct
        if s.n_distinct and ((key and s.is_unique) or versioned):
            out.append((t, c))
    return out[:PARENTS]


def _children(doc: dict, stats: Stats) -> list[tuple[str, str]]:
    out = []
    for (t, c), column in _columns(doc).items():
        s = stats[t][c]
        number = is_numeric(s.kind) and column["entity_role"] == "dimension" and 2 <= s.n_distinct <= 100_000
        if s.n_distinct and (column["entity_role"] == "foreign_key" or (column["semantic_type"] == "identifier" and not s.is_unique) or number or looks_like_key(c)):
            out.append((t, c))
    return sorted(out)


def candidates(doc: dict, stats: Stats, key_suffixes: tuple[str, ...] = ()) -> list[Candidate]:
    """Pairs worth a test: other table, same type family, no more values than the parent; the best names first.

    ``key_suffixes`` (for instance ``("key",)``) also takes names that end so, without an underscore, as children."""
    parents, out = _parents(doc, stats), []
    fused = [(t, c) for t, columns in stats.items() for c in columns if key_suffixes and c.lower().endswith(key_suffixes)]
    parents += [p for p in fused if stats[p[0]][p[1]].is_unique and p not in parents]
    children = sorted({*_children(doc, stats), *fused})
    for t, c in children:
        s, own = stats[t][c], []
        for pt, pc in parents:
            p = stats[pt][pc]
            if pt != t and family(p.kind) == family(s.kind) and s.n_distinct <= p.n_distinct:
                own.append(Candidate((t, c), (pt, pc), similarity(c, pt, pc), child_distinct=s.n_distinct, parent_distinct=p.n_distinct))
        out += sorted(own, key=lambda x: -x.name_score)[:TESTS]
    return out


def measure(source, found: list[Candidate]) -> list[Candidate]:
    """Fill in the inclusion ratio of all candidates by one job, and keep those that reach LEAST_RATIO."""
    if not found:
        return []
    names = {".".join(x): x for c in found for x in (c.child, c.parent)}
    columns = {n: (source.df(t), c) for n, (t, c) in names.items()}
    ratios = {(r["child"], r["parent"]): r["ratio"] for r in inclusion_matrix(columns, [(".".join(c.child), ".".join(c.parent)) for c in found]).collect()}
    for c in found:
        c.ratio = ratios[".".join(c.child), ".".join(c.parent)]
    return [c for c in found if c.ratio >= LEAST_RATIO]


def direct(found: list[Candidate], stats: Stats) -> list[Candidate]:
    """Of two unique columns with the same values, the one named after its own table is the parent."""
    seen = {(c.child, c.parent) for c in found}
    out = []
    for c in found:
        both = stats[c.child[0]][c.child[1]].is_unique and c.child_distinct == c.parent_distinct and (c.parent, c.child) in seen
        if both and (similarity(c.parent[1], *c.child), c.child) > (similarity(c.child[1], *c.parent), c.parent):
            continue
        out.append(c)
    return out


def judge(found: list[Candidate], provider) -> None:
    """Ask a language model, BATCH at a time, whether each reference makes sense."""
    for lo in range(0, len(found), BATCH):
        part = found[lo : lo + BATCH]
        text = json.dumps([{"n": i, "child": ".".join(c.child), "parent": ".".join(c.parent)} for i, c in enumerate(part)])
        for a in provider.json("For each pair, is the child column a plausible foreign key to the parent? JSON array of {n, verdict: plausible|implausible}.", text) or []:
            if isinstance(a, dict) and a.get("n") in range(len(part)) and a.get("verdict") in ("plausible", "implausible"):
                part[a["n"]].verdict = a["verdict"]


def decide(found: list[Candidate]) -> dict[str, list[Candidate]]:
    """The best candidate of each child: accepted, for review, or killed. Statistics alone never accept: the names
    must agree, and a language model, where there is one, must not object."""
    best: dict[tuple[str, str], Candidate] = {}
    for c in found:
        old = best.get(c.child)
        if old is None or (c.name_score, c.ratio) > (old.name_score, old.ratio):
            best[c.child] = c
    out: dict[str, list[Candidate]] = {"accepted": [], "review": [], "killed": []}
    for c in best.values():
        place = "killed" if c.verdict == "implausible" else "accepted" if c.name_score >= ACCEPT else "review"
        out[place].append(c)
    return out


def apply(doc: dict, accepted: list[Candidate]) -> None:
    columns, names = _columns(doc), set()
    doc.setdefault("relationships", [])
    for c in accepted:
        sure = round(min(0.9, 0.6 + 0.2 * c.name_score + 0.1 * (c.verdict == "plausible")), 3)
        column = columns[c.child]
        column |= {"entity_role": "foreign_key", "semantic_type": "identifier" if column["semantic_type"] in ("unknown", "quantity", "identifier") else column["semantic_type"], "foreign_key": {"references": ".".join(c.parent)}}
        column.pop("aggregations", None)
        column["provenance"].append({"signal": "inclusion_dependency", "detail": f"{c.ratio:.3f} of values in {'.'.join(c.parent)}"})
        name = f"{c.child[0]}_to_{c.parent[0]}"
        name = f"{name}_{c.child[1]}" if name in names else name  # several roles of one dimension
        names.add(name)
        column["foreign_key"]["relationship"] = name
        doc["relationships"].append(
            {"name": name, "from": {"table": c.child[0], "columns": [c.child[1]]}, "to": {"table": c.parent[0], "columns": [c.parent[1]]}, "cardinality": "many_to_one", "join_type": "left", "fanout_risk": False, "reverse_fanout_risk": True, "lifecycle": "inferred", "confidence": sure}
        )


def hierarchies(doc: dict, stats: Stats, source) -> None:
    """A column that refers to its own table's key, and pairs of parent and child columns."""
    out = doc.setdefault("hierarchies", [])
    for t in doc["tables"]:
        key = t["primary_key"][0] if t["primary_key"] else None
        names = [c["name"] for c in t["columns"]]
        asked = [Candidate((t["name"], c), (t["name"], key), 0) for c in names if key and c != key and has(c, *RECURSIVE) and not stats[t["name"]][c].is_unique and stats[t["name"]][c].n_distinct >= 2 and family(stats[t["name"]][c].kind) == family(stats[t["name"]][key].kind)]
        for c in measure(source, asked):
            out.append({"kind": "recursive", "name": f"{t['name']}_{c.child[1]}", "dimension_table": t["name"], "recursive": {"parent_column": c.child[1], "child_column": key}, "confidence": 0.7, "lifecycle": "inferred"})
        for c in names:
            other = c.replace("parent", "child", 1)
            if c.lower().startswith("parent") and other in names:
                out.append({"kind": "recursive", "name": f"{t['name']}_{c}", "dimension_table": t["name"], "recursive": {"parent_column": c, "child_column": other}, "confidence": 0.75, "lifecycle": "inferred"})


def table_type(table: dict, out_links: int, in_links: int) -> str:
    """By name first, then by columns, then by links and measures; the first sign decides."""
    name, columns = table["name"].lower(), [c["name"].lower() for c in table["columns"]]
    measures = sum(c["entity_role"] == "measure" for c in table["columns"])
    isolated = not out_links and not in_links
    if has(name, *STAGING):
        return "staging"
    if has(name, *OPS) and not in_links:
        return "operational"
    if has_validity(columns) or has(name, *SNAPSHOT) or set(MARKERS) & set(columns):
        return "snapshot_scd2"
    if has(name, *AGGREGATE) and measures:
        return "aggregate"
    if has(name, *DIMENSION):
        return "dimension"
    if len(columns) > WIDE:
        return "denormalized"
    if measures and (out_links >= 2 or out_links == 1 and not in_links):
        return "fact"
    if not measures and (in_links or len(columns) <= 4 and any(c.endswith(("_name", "_nm")) for c in columns)):
        return "dimension"
    if measures >= 2:
        return "fact"
    return "operational" if isolated and not measures else "unknown"


def link(spark: SparkSession, doc: dict, stats: Stats, source, provider=None, key_suffixes: tuple[str, ...] = ()) -> dict[str, list[Candidate]]:
    found = direct(measure(source, candidates(doc, stats, key_suffixes)), stats)
    if provider is not None:
        judge([c for c in found if c.name_score >= REVIEW_FLOOR], provider)
    decision = decide(found)
    apply(doc, decision["accepted"])
    hierarchies(doc, stats, source)
    for t in doc["tables"]:
        outgoing = sum(r["from"]["table"] == t["name"] for r in doc["relationships"])
        incoming = sum(r["to"]["table"] == t["name"] for r in doc["relationships"])
        t["table_type"] = table_type(t, outgoing, incoming)
        if t["table_type"] == "snapshot_scd2" and has_validity([c["name"].lower() for c in t["columns"]]):
            names = {c["name"].lower(): c["name"] for c in t["columns"]}
            start = next((names[c] for c in names if c in ("eff_start_dt", "valid_from") or c.endswith("_start_dt")), None)
            end = next((names[c] for c in names if c in ("eff_end_dt", "valid_to") or c.endswith("_end_dt")), None)
            flag = next((names[c] for c in names if c.startswith("is_curr")), None)
            t["scd"] = {"type": 2, "valid_from": start, "valid_to": end, "is_current_flag": flag}
    return decision
