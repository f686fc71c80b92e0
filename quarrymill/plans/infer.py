"""A warehouse becomes a document: profile, typing, links, enrichment."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..operators.profile import ColumnStats, profile_table
from ..sources.context import BUDGET, Bundle, apply_dictionary, decode_claims, promote, ratio_claims
from . import enrich as E
from . import link as L
from .describe import describe
from .model import new
from .typing import escalate, recheck, table_document


@dataclass
class Report:
    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    audit: dict[str, list[str]] = field(default_factory=dict)
    llm_calls: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


def infer(spark: SparkSession, source, name: str, provider=None, context: Bundle | None = None, key_suffixes: tuple[str, ...] = (), send_values: bool = True) -> tuple[dict, Report]:
    """The document and a report of seconds and counts. Without a provider everything is deterministic."""
    report = Report()

    def timed(stage: str, f):
        began = time.perf_counter()
        out = f()
        report.seconds[stage] = round(time.perf_counter() - began, 3)
        return out

    def profiled() -> dict[str, dict[str, ColumnStats]]:
        return {(t.qualified if t.schema else t.name): profile_table(source.df(t.qualified)) for t in source.tables()}

    stats = timed("profile", profiled)
    doc = new(name, timed("typing", lambda: [table_document(t, t, s) for t, s in stats.items()]))
    if provider is not None:
        timed("escalate", lambda: [escalate(t, stats[t["name"]], provider, send_values) for t in doc["tables"]])
    if context:
        apply_dictionary(doc, context)
        if provider is not None:
            report.counts["promoted"] = timed("promote", lambda: promote(doc, context, lambda t, c, text: recheck(t, c, text[:BUDGET], provider)))
    decision = timed("link", lambda: L.link(spark, doc, stats, source, provider, key_suffixes))
    if provider is not None:
        timed("describe", lambda: describe(doc, stats, provider))
    timed("enrich", lambda: E.enrich(doc, stats, source))
    if context:
        decode_claims(doc, context)
        ratio_claims(doc, context)
    report.audit = {k: [f"{'.'.join(c.child)} -> {'.'.join(c.parent)}" for c in v] for k, v in decision.items()}
    if tenants := collapse_tenants(doc):
        doc["tenant_templates"] = tenants
    report.counts |= {"tables": len(doc["tables"]), "columns": sum(len(t["columns"]) for t in doc["tables"]), "relationships": len(doc["relationships"]), "metrics": len(doc["metrics"])}
    report.llm_calls = getattr(provider, "calls", 0)
    return doc, report


def collapse_tenants(doc: dict) -> list[dict]:
    """Tables of several schemas with the same name and columns: one template each, with its instances."""
    shapes: dict[tuple, list[str]] = {}
    for t in doc["tables"]:
        schema, dot, short = t["name"].rpartition(".")
        if dot:
            shapes.setdefault((short, tuple((c["name"], c["sql_type"]) for c in t["columns"])), []).append(schema)
    return [{"name": short, "tenant_template": {"parameter": "schema", "instances": sorted(found)}} for (short, _), found in shapes.items() if len(found) > 1]
