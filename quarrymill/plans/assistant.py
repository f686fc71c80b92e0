"""The seam to a language model: a provider answers text; recordings make runs repeatable. And what is built on it."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from ..errors import MissingAnswer
from .compile import Compiled, compile_metric
from .graph import base_graph
from .scoring import same_rows, same_scalar


class Provider(Protocol):
    calls: int

    def text(self, system: str, user: str) -> str: ...

    def json(self, system: str, user: str): ...


def parse_json(text: str):
    """The first JSON value in an answer, fenced or not; None if there is none."""
    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", text, re.S), text]:
        starts = [i for i in (part.find("["), part.find("{")) if i >= 0]
        if starts:
            try:
                return json.JSONDecoder().raw_decode(part[min(starts) :])[0]
            except ValueError:
                continue
    return None


class Recorded:
    """Answers from a folder of recordings; what is missing is asked of ``ask`` and recorded, or is an error without."""

    def __init__(self, folder: str | Path, model: str, ask: Callable[[str, str], str] | None = None):
        self.folder, self.model, self.ask, self.calls = Path(folder), model, ask, 0

    def _key(self, system: str, user: str) -> str:
        return hashlib.sha256("\0".join((self.model, system, user)).encode()).hexdigest()[:32]

    def text(self, system: str, user: str) -> str:
        self.calls += 1
        place = self.folder / f"{self._key(system, user)}.json"
        if place.exists():
            return json.loads(place.read_text(encoding="utf-8"))["answer"]
        if self.ask is None:
            raise MissingAnswer(f"no recording {place.name}", "give the provider a way to ask, or record first")
        answer = self.ask(system, user)
        self.folder.mkdir(parents=True, exist_ok=True)
        draft = place.with_suffix(f".{os.getpid()}.tmp")
        draft.write_text(json.dumps({"model": self.model, "system": system, "user": user, "answer": answer}), encoding="utf-8")
        draft.replace(place)
        return answer

    def json(self, system: str, user: str):
        return parse_json(self.text(system, user))


class Scripted:
    """Answers by a function; for tests."""

    def __init__(self, answer: Callable[[str, str], object]):
        self.answer, self.calls = answer, 0

    def text(self, system: str, user: str) -> str:
        self.calls += 1
        out = self.answer(system, user)
        return out if isinstance(out, str) else json.dumps(out)

    def json(self, system: str, user: str):
        return parse_json(self.text(system, user))


def context(doc: dict, kind: str) -> str:
    """What an answerer sees: ``schema_only``, ``semantic``, or ``graph`` (semantic and join edges)."""
    lines = []
    for t in doc["tables"]:
        if kind != "schema_only" and t.get("lifecycle") in ("deprecated", "orphaned"):
            lines.append(f"{t['name']}: UNUSABLE, use {t.get('deprecation', {}).get('replacement')}")
            continue
        columns = [f"{c['name']} {c['sql_type']}" + ("" if kind == "schema_only" else f" [{c['semantic_type']}, {c['entity_role']}]" + ("".join(f" {v['value']}={v['meaning']}" for v in c.get("enum_values", []) if v.get("meaning") and v.get("decode_source") != "llm_guess"))) for c in t["columns"]]
        lines.append(f"{t['name']}({', '.join(columns)})")
        if kind != "schema_only":
            lines += [f"  note: {n}" for n in t.get("knowledge", {}).get("usage_notes", [])] + [f"  filter: {f['expr']}" for f in t.get("knowledge", {}).get("required_filters", [])]
    if kind != "schema_only":
        for m in doc.get("metrics", []):
            out = compile_metric(doc, m["name"])
            lines.append(f"metric {m['name']}: " + (out.sql.replace("\n", " ") if isinstance(out, Compiled) else out.reason))
    if kind == "graph":
        lines += [f"{e['from']} -> {e['to']} ({e['kind']})" for e in base_graph(doc)["edges"]]
    return "\n".join(lines)


def answer(spark: SparkSession, doc: dict, question: str, provider: Provider, kind: str = "semantic") -> dict:
    """SQL by the model, run once, repaired once if analysis or execution fails. A refusal is an answer."""
    system = "Answer with one Spark SQL query in a ```sql block, or REFUSE: and a reason if the data can't answer safely.\n" + context(doc, kind)
    asked = question
    for attempt in (0, 1):
        said = provider.text(system, asked)
        if said.strip().upper().startswith("REFUSE"):
            return {"kind": "refusal", "reason": said.strip()[7:].strip(" :")}
        block = re.search(r"```(?:sql)?\s*(.*?)```", said, re.S)
        sql = (block[1] if block else said).strip().rstrip(";")
        try:
            return {"kind": "rows", "sql": sql, "rows": [tuple(r) for r in spark.sql(sql).collect()], "repaired": bool(attempt)}
        except Exception as e:  # the message goes back to the model
            asked = f"{question}\n\nThis failed:\n{sql}\n{str(e)[:500]}"
            failed = {"kind": "error", "sql": sql, "error": str(e)[:500]}
    return failed


def score(spark: SparkSession, question: dict, got: dict) -> bool:
    if question["expected_kind"] in ("refusal", "clarification"):
        return got["kind"] == "refusal"
    if got["kind"] != "rows":
        return False
    want = [tuple(r) for r in spark.sql(next(iter(question["expected_sql"].values()))).collect()]
    if question["expected_kind"] == "scalar":
        return bool(got["rows"]) and bool(want) and same_scalar(got["rows"][0][-1], want[0][-1], question.get("tolerance") or 0.01)
    return same_rows(got["rows"], want)


def benchmark(spark: SparkSession, doc: dict, questions: list[dict], provider: Provider, kinds=("schema_only", "semantic", "graph")) -> dict:
    """Passes by kind of context and by complexity."""
    out: dict = {}
    for kind in kinds:
        for q in questions:
            good = score(spark, q, answer(spark, doc, q["question"], provider, kind))
            cell = out.setdefault(kind, {}).setdefault(q.get("complexity", "simple"), [0, 0])
            cell[0] += good
            cell[1] += 1
    return out


def generate(spark: SparkSession, doc: dict, provider: Provider, count: int = 10) -> list[dict]:
    """Questions by the model that run and that a second, sceptical look accepts. Unclear verdicts reject."""
    made = provider.json(f"Write {count} questions with Spark SQL about this model. JSON array of {{question, sql}}.", context(doc, "semantic"))
    out = []
    for q in made if isinstance(made, list) else []:
        try:
            spark.sql(q["sql"]).schema
        except Exception:  # whatever is wrong with it, it is no question
            continue
        verdict = provider.json("Is this question well posed, and does the SQL answer it safely? JSON {verdict: accept|reject}.", json.dumps(q))
        if isinstance(verdict, dict) and verdict.get("verdict") == "accept":
            out.append(q)
    return out
