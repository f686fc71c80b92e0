"""What a column means, from its name, type and statistics. The first rule that answers wins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.names import ends, has
from ..functions.types import is_nested, is_numeric, is_temporal, is_text
from ..operators.profile import ColumnStats
from pyspark.sql import types as T

# Semantic types, roles, and what names say.
SEMANTIC_TYPES = (
    "identifier natural_key monetary_value quantity rate percentage date timestamp_event duration status_code code enum flag name free_text url json_object "
    "pii_email pii_phone pii_name pii_address pii_national_id geo_country geo_region geo_city geo_postal geo_coordinates version unknown"
).split()
ROLES = "primary_key unique_key foreign_key natural_key dimension measure metadata".split()
EMAIL, URL = re.compile(r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$"), re.compile(r"^https?://")
_CODE = "(?:_cd|_code)?"
NAMES = [
    ("pii_email", 0.9, "email|e_mail"),
    ("pii_phone", 0.85, "phone|mobile|fax"),
    ("pii_national_id", 0.9, "ssn|tax_id|national_id|passport"),
    ("pii_name", 0.75, "(?:first|last|full|cust|customer|user|contact)_?(?:nm|name)"),
    ("pii_address", 0.75, "street|address|addr_ln|address_line|addr1|addr2"),
    ("geo_country", 0.85, f"(?:country|ctry){_CODE}"),
    ("geo_region", 0.8, f"(?:state|province|region|rgn){_CODE}"),
    ("geo_city", 0.85, "city"),
    ("geo_postal", 0.85, f"(?:zip|postal){_CODE}"),
    ("geo_coordinates", 0.85, "lat|latitude|lon|lng|longitude"),
    ("monetary_value", 0.8, "amt|amount|price|cost|total|revenue|rev|sales|paid|balance|bal|mrr|fee|charge"),
    ("quantity", 0.75, "qty|quantity|units|cnt|count|num"),
    ("rate", 0.75, "rate|ratio"),
    ("percentage", 0.8, "pct|percent|percentage"),
    ("status_code", 0.7, f"(?:sts|status|state){_CODE}"),
    ("code", 0.6, f"(?:typ|type|cat|category|class|seg|segment|tier|mthd|method|chnl|channel|rsn|reason){_CODE}"),
    ("flag", 0.7, "is|has|flg|flag|active|enabled|deleted"),
    ("url", 0.85, "url|link|href"),
    ("free_text", 0.7, "desc|description|comment|notes?|txt|text|title"),
    ("name", 0.65, "(?:nm|name)(?=_?$)"),
]
AUDIT = ("crt", "created", "updt", "updated", "upd", "load", "etl", "ingest", "src_sys", "source_system", "batch", "audit")
MEASURES, METADATA = ("monetary_value", "quantity", "rate", "percentage"), ("free_text", "url")
VALUES_AGREE, FEW, WEAK = 0.8, 30, 0.7


@dataclass
class Typing:
    semantic_type: str
    role: str
    confidence: float
    signal: str
    detail: str


def role_of(kind: str) -> str:
    return "measure" if kind in MEASURES else "metadata" if kind in METADATA else "dimension"


def _audit(name: str) -> bool:
    return has(name, *AUDIT) or ends(name, "at", "ts")


def _by_values(s: ColumnStats) -> Typing | None:
    values = [str(v) for v, _ in s.top_values]
    for pattern, kind, role, sure in ((EMAIL, "pii_email", "dimension", 0.95), (URL, "url", "metadata", 0.9)):
        if values and sum(bool(pattern.match(v)) for v in values) >= VALUES_AGREE * len(values):
            return Typing(kind, role, sure, "statistic", f"values look like {kind}")
    return None


def _by_kind(s: ColumnStats) -> Typing | None:
    if isinstance(s.kind, T.BooleanType):
        return Typing("flag", "dimension", 0.9, "statistic", "boolean")
    if is_temporal(s.kind):
        if _audit(s.name):
            return Typing("timestamp_event", "metadata", 0.75, "naming", "audit time")
        return Typing("date", "dimension", 0.8, "statistic", "date") if isinstance(s.kind, T.DateType) else Typing("timestamp_event", "dimension", 0.7, "statistic", "timestamp")
    return Typing("json_object", "metadata", 0.85, "statistic", "nested") if is_nested(s.kind) else None


def _by_key_name(s: ColumnStats) -> Typing | None:
    role = "primary_key" if s.is_unique else "foreign_key"
    if ends(s.name, "no", "nbr", "number") and (s.is_unique or s.cardinality_ratio > 0.5):
        return Typing("identifier", role, 0.6, "naming", "number-like name with many values")
    if ends(s.name, "id", "key", "sk", "pk") or s.name.lower().startswith("id_"):
        if not is_numeric(s.kind) and s.cardinality_ratio < 0.01 and s.n_distinct < 50:
            return Typing("code", "dimension", 0.55, "statistic", "key-like name with few values")
        return Typing("identifier", role, 0.85 if s.is_unique else 0.7, "naming", "key-like name")
    return None


def _by_name(s: ColumnStats) -> Typing | None:
    for kind, sure, pattern in NAMES:
        if re.search(f"(?:^|_)(?:{pattern})(?:$|_)", s.name.lower()):
            if kind in ("status_code", "code") and 0 < s.n_distinct <= FEW:
                sure = min(0.9, sure + 0.15)
            return Typing(kind, role_of(kind), round(sure, 2), "naming", f"name says {kind}")
    return Typing("unknown", "metadata", 0.6, "naming", "audit column") if _audit(s.name) else None


def _by_numbers(s: ColumnStats) -> Typing | None:
    if not is_numeric(s.kind):
        return None
    if s.is_unique:
        return Typing("identifier", "primary_key", 0.6, "statistic", "unique numbers")
    if isinstance(s.kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        return Typing("monetary_value", "measure", 0.4, "statistic", "fractional numbers")
    return Typing("code", "dimension", 0.45, "statistic", "few numbers") if s.n_distinct <= FEW else Typing("quantity", "measure", 0.35, "statistic", "many numbers")


def _by_text(s: ColumnStats) -> Typing | None:
    if not is_text(s.kind):
        return None
    if (s.avg_len or 0) > 40:
        return Typing("free_text", "metadata", 0.6, "statistic", "long texts")
    if 0 < s.n_distinct <= FEW and s.row_count > 100:
        return Typing("enum", "dimension", 0.6, "statistic", "few texts in many rows")
    return Typing("date", "dimension", 0.5, "naming", "date-like name") if has(s.name, "dt", "date") else None


RULES: list[Callable[[ColumnStats], Typing | None]] = [_by_values, _by_kind, _by_key_name, _by_name, _by_numbers, _by_text]


def classify(s: ColumnStats) -> Typing:
    return next((t for rule in RULES if (t := rule(s))), Typing("unknown", "dimension", 0.2, "statistic", "no rule applies"))


AGGREGATIONS = ["sum", "avg", "min", "max", "count"]


def table_document(name: str, source: str, stats: dict[str, ColumnStats]) -> dict:
    """A table of the document: typed columns and the primary key, the surest of its candidates."""
    typed = {c: classify(s) for c, s in stats.items()}
    keys = [c for c, t in typed.items() if t.role == "primary_key"]
    best = max(keys, key=lambda c: typed[c].confidence, default=None)
    columns = []
    for c, t in typed.items():
        role = "unique_key" if c in keys and c != best else t.role
        column = {"name": c, "sql_type": stats[c].sql_type, "semantic_type": t.semantic_type, "entity_role": role, "confidence": t.confidence, "lifecycle": "inferred", "provenance": [{"signal": t.signal, "detail": t.detail}]}
        if t.semantic_type.startswith("pii_"):
            column["pii"] = True
        if role == "measure":
            column["aggregations"] = {"allowed": list(AGGREGATIONS), "default": "sum"}
        if t.semantic_type in ("status_code", "enum", "code") and stats[c].top_values and stats[c].n_distinct <= FEW:
            column["enum_values"] = [{"value": str(v)} for v, _ in stats[c].top_values]
        columns.append(column)
    return {"name": name, "source": source, "table_type": "unknown", "lifecycle": "inferred", "primary_key": [best] if best else [], "columns": columns}


def escalate(table: dict, stats: dict[str, ColumnStats], provider, send_values: bool = True) -> int:
    """Ask a language model about columns below WEAK confidence, all of a table at once. Labels outside the
    vocabularies are dropped; confidence is held between 0.5 and 0.85. Returns the number of columns changed."""
    weak = [c for c in table["columns"] if c["confidence"] < WEAK]
    if not weak:
        return 0
    facts = [{"name": c["name"], "sql_type": c["sql_type"], "distinct": stats[c["name"]].n_distinct, "rows": stats[c["name"]].row_count} | ({"values": [str(v) for v, _ in stats[c["name"]].top_values[:5]]} if send_values else {}) for c in weak]
    system = "Classify warehouse columns. Answer with a JSON array of {name, semantic_type, entity_role, confidence}. Types: " + ", ".join(SEMANTIC_TYPES) + ". Roles: " + ", ".join(ROLES)
    answers = provider.json(system, json.dumps({"table": table["name"], "columns": facts}))
    named = {c["name"]: c for c in weak}
    changed = 0
    for a in answers if isinstance(answers, list) else []:
        c = named.get(a.get("name")) if isinstance(a, dict) else None
        if c is None or a.get("semantic_type") not in SEMANTIC_TYPES or a.get("entity_role") not in ROLES:
            continue
        c |= {"semantic_type": a["semantic_type"], "entity_role": a["entity_role"], "confidence": min(0.85, max(0.5, float(a.get("confidence", 0.5))))}
        c["provenance"].append({"signal": "llm", "detail": "typed by a language model"})
        changed += 1
    return changed


def recheck(table: dict, column: dict, text: str, provider) -> str | None:
    """What a language model takes a column for that ``text`` speaks of; nothing if it is no known type."""
    system = "A document speaks of a warehouse column. Answer with a JSON object {semantic_type}. Types: " + ", ".join(SEMANTIC_TYPES)
    answer = provider.json(system, json.dumps({"table": table["name"], "name": column["name"], "sql_type": column["sql_type"], "type": column["semantic_type"], "text": text}))
    kind = answer.get("semantic_type") if isinstance(answer, dict) else None
    return kind if kind in SEMANTIC_TYPES else None
