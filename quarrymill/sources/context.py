"""Documents that come with a warehouse: dictionaries, wikis and notes."""

from __future__ import annotations

import csv
import glob
import io
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..operators.text import strip_html

# What is read, what is skipped, and how dictionaries name their columns.
KINDS = (".md", ".txt", ".rst", ".html", ".htm", ".csv", ".tsv")
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target")
LIMIT = 2_000_000
HEADERS = {
    "table": ("table", "table_name", "tbl", "entity", "dataset"),
    "column": ("column", "column_name", "col", "field", "field_name", "attribute"),
    "description": ("description", "desc", "definition", "meaning", "comment", "notes"),
}
BUDGET, SHOWN = 1500, 200
HEADING = re.compile(r"^#{1,6} +(.*)$", re.M)


@dataclass
class Chunk:
    path: str
    heading: str
    body: str

    @property
    def tokens(self) -> frozenset[str]:
        return frozenset(w for w in re.split(r"\W+", f"{self.heading} {self.body}".lower()) if len(w) > 2)


@dataclass
class Bundle:
    chunks: list[Chunk] = field(default_factory=list)
    entries: list[dict] = field(default_factory=list)


def split(path: str, text: str) -> list[Chunk]:
    """One chunk a heading, and one for what stands before the first."""
    marks = list(HEADING.finditer(text))
    out = [Chunk(path, "", text[: marks[0].start() if marks else None].strip())]
    for m, after in zip(marks, [*marks[1:], None]):
        out.append(Chunk(path, m[1].strip(), text[m.end() : after.start() if after else None].strip()))
    return [c for c in out if c.heading or c.body]


def dictionary(text: str, tabs: bool = False) -> list[dict]:
    """(table, column, description) rows of a data dictionary; nothing if it isn't one."""
    rows = list(csv.DictReader(io.StringIO(text), delimiter="\t" if tabs else ","))
    if not rows:
        return []
    named = {kind: next((h for h in rows[0] if h and h.strip().lower() in names), None) for kind, names in HEADERS.items()}
    if not named["column"] or not named["description"]:
        return []
    out = [{kind: (r.get(h) or "").strip() if h else "" for kind, h in named.items()} for r in rows]
    return [r for r in out if r["column"] and r["description"]]


def load_context(specs: list[str]) -> Bundle:
    """Files, folders and globs. It is an error if a spec matches nothing."""
    out = Bundle()
    for spec in specs:
        place = Path(spec)
        found = [p for p in place.rglob("*") if not set(p.parts) & set(SKIPPED)] if place.is_dir() else [place] if place.is_file() else [Path(p) for p in glob.glob(spec, recursive=True)]
        found = sorted(p for p in found if p.is_file() and p.suffix.lower() in KINDS and p.stat().st_size <= LIMIT)
        if not found:
            raise FileNotFoundError(f"nothing to read in {spec}")
        for p in found:
            text = p.read_text(encoding="utf-8", errors="replace")
            if p.suffix.lower() in (".csv", ".tsv"):
                entries = dictionary(text, p.suffix.lower() == ".tsv")
                if entries:
                    out.entries += entries
                    continue
            out.chunks += split(str(p), strip_html(text) if p.suffix.lower().startswith(".htm") else text)
    return out


def excerpts(bundle: Bundle, words: set[str], budget: int = BUDGET) -> list[Chunk]:
    """Chunks that share most words, best first, as many as fit; the last is cut where the budget ends."""
    ranked = sorted((c for c in bundle.chunks if c.tokens & words), key=lambda c: -len(c.tokens & words))
    out = []
    for c in ranked:
        if budget <= 0:
            break
        out.append(replace(c, body=c.body[:budget]))
        budget -= len(c.body)
    return out


def apply_dictionary(doc: dict, bundle: Bundle) -> int:
    """Fill in missing descriptions; entries for the table come before ones for any table."""
    n = 0
    for t in doc["tables"]:
        for c in t["columns"]:
            fits = [e for e in bundle.entries if e["column"].lower() == c["name"].lower() and e["table"].lower() in ("", t["name"].lower())]
            if fits and not c.get("description"):
                best = max(fits, key=lambda e: bool(e["table"]))
                c["description"] = best["description"][:SHOWN]
                c["provenance"].append({"signal": "docs", "detail": "data dictionary"})
                n += 1
    return n


_CLAIM = re.compile(r"\b([A-Z0-9]{1,4})\s*(?:=|:|->|means)\s*\"?([A-Za-z][A-Za-z -]{2,30})")
_RATIO = re.compile(r"\b(\w+)\s*=\s*(\w+)\.(\w+)\s*/\s*(\w+)\.(\w+)")
BEFORE, AFTER = 50, 400


def decode_claims(doc: dict, bundle: Bundle) -> int:
    """What texts say codes mean, near a mention of the column: it corroborates, replaces a guess, or is a conflict."""
    n = 0
    for t in doc["tables"]:
        for c in t["columns"]:
            values = {str(v["value"]): v for v in c.get("enum_values", [])}
            for chunk in bundle.chunks if values else []:
                for at in re.finditer(rf"\b{re.escape(c['name'])}\b", chunk.body, re.I):
                    near = chunk.body[max(0, at.start() - BEFORE) : at.end() + AFTER]
                    for code, meaning in _CLAIM.findall(near):
                        v, meaning = values.get(code), meaning.strip()
                        if v is None:
                            continue
                        n += 1
                        old = v.get("meaning")
                        if old is None or v.get("decode_source") == "llm_guess":
                            v |= {"meaning": meaning, "decode_source": "docs"}
                        elif old.lower() != meaning.lower():
                            said = {"between": [v.get("decode_source", "data"), "docs"], "detail": f"{code} is {old!r}, but {chunk.path} says {meaning!r}"}
                            if said not in c.setdefault("conflicts", []):
                                c["conflicts"].append(said)
                        else:
                            c["provenance"].append({"signal": "docs", "detail": f"{code} = {meaning} in {chunk.path}"})
    return n


def ratio_claims(doc: dict, bundle: Bundle) -> int:
    """``name = table.column / table.column`` in a text becomes a ratio metric if both columns exist."""
    known = {(t["name"].lower(), c["name"].lower()): f"{t['name']}.{c['name']}" for t in doc["tables"] for c in t["columns"]}
    taken, n = {m["name"] for m in doc.setdefault("metrics", [])}, 0
    for chunk in bundle.chunks:
        for name, a, b, c, d in _RATIO.findall(chunk.body):
            top, bottom = known.get((a.lower(), b.lower())), known.get((c.lower(), d.lower()))
            if top and bottom and name not in taken:
                taken.add(name)
                doc["metrics"].append({"name": name, "type": "ratio", "numerator": top, "denominator": bottom, "lifecycle": "inferred", "confidence": 0.7, "provenance": [{"signal": "docs", "detail": chunk.path}]})
                n += 1
    return n


def promote(doc: dict, bundle: Bundle, classify_again) -> int:
    """Columns that a text names together with their table are typed again; a change is recorded as a conflict."""
    n = 0
    for t in doc["tables"]:
        for c in t["columns"]:
            named = {t["name"].rpartition(".")[2].lower(), c["name"].lower()}
            near = next((x for x in bundle.chunks if named <= x.tokens), None)
            kind = classify_again(t, c, near.body) if near else None
            if kind and kind != c["semantic_type"]:
                c.setdefault("conflicts", []).append({"between": ["statistic", "docs"], "detail": f"{c['semantic_type']} became {kind} by {near.path}"})
                c["semantic_type"] = kind
                c["provenance"].append({"signal": "docs", "detail": near.path})
                n += 1
    return n
