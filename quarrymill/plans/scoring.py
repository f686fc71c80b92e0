"""How good an inferred document and an answer are, against a gold one."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that count as the same.
ALIKE = [{"code", "enum", "status_code"}, {"date", "timestamp_event"}, {"identifier", "natural_key"}, {"rate", "percentage"}, {"name", "pii_name"}]


def same_type(a: str, b: str) -> bool:
    return a == b or any({a, b} <= s for s in ALIKE)


def score_document(got: dict, gold: dict) -> dict[str, float]:
    """Lenient type accuracy, macro F1 over the gold's types, role accuracy, precision and recall of keys and links."""
    mine = {(t["name"], c["name"]): c for t in got["tables"] for c in t["columns"]}
    pairs = [(mine[k], c) for t in gold["tables"] for c in t["columns"] if (k := (t["name"], c["name"])) in mine]
    n = max(len(pairs), 1)
    f1 = []
    for kind in {g["semantic_type"] for _, g in pairs}:
        hit = sum(same_type(m["semantic_type"], kind) and g["semantic_type"] == kind for m, g in pairs)
        said, there = sum(m["semantic_type"] == kind for m, _ in pairs), sum(g["semantic_type"] == kind for _, g in pairs)
        f1.append(2 * hit / (said + there) if said + there else 0.0)
    keys = lambda d: {(t["name"], *t.get("primary_key", [])) for t in d["tables"] if t.get("primary_key")}
    links = lambda d: {(f"{t['name']}.{c['name']}", c["foreign_key"]["references"]) for t in d["tables"] for c in t["columns"] if c.get("foreign_key", {}).get("references")}
    out = {"type_accuracy": sum(same_type(m["semantic_type"], g["semantic_type"]) for m, g in pairs) / n, "type_macro_f1": min(1.0, sum(f1) / max(len(f1), 1)), "role_accuracy": sum(m["entity_role"] == g["entity_role"] for m, g in pairs) / n}
    for name, f in (("pk", keys), ("fk", links)):
        a, b = f(got), f(gold)
        out |= {f"{name}_precision": len(a & b) / len(a) if a else 1.0, f"{name}_recall": len(a & b) / len(b) if b else 1.0}
    return out


def confusion(got: DataFrame, gold: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(expected, found, n) of labels by key."""
    both = gold.select(*keys, F.col(label).alias("expected")).join(got.select(*keys, F.col(label).alias("found")), keys, "left")
    return both.groupBy("expected", "found").agg(F.count("*").alias("n"))


def _plain(v):
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return round(float(v), 2)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if v is None or isinstance(v, (str, bool)) else str(v)


def same_rows(a: list[tuple], b: list[tuple]) -> bool:
    """The same rows as often, in any order, numbers rounded to cents whatever their type."""
    rows = lambda x: Counter(tuple(_plain(v) for v in r) for r in x)
    return rows(a) == rows(b)


def same_scalar(a, b, tolerance: float = 0.01) -> bool:
    if isinstance(a, (int, float, Decimal)) and isinstance(b, (int, float, Decimal)):
        return abs(float(a) - float(b)) <= max(tolerance, 0.001 * abs(float(b)))
    return a == b


def same_frames(a: DataFrame, b: DataFrame) -> bool:
    """For results of data size: multiset equality without gathering rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
