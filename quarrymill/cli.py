"""python -m quarrymill.cli: validate, init, infer, review, tools, drift, compile, export. Exit 0: fine, 1: found something, 2: error."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from .errors import EngineError
from .plans import drift as D
from .plans import export as X
from .plans import model as M
from .plans.compile import Compiled, compile_metric
from .plans.infer import infer
from .plans.review import apply as apply_verdicts
from .plans.review import collect
from .plans.search import tools
from .plans.serve import serve
from .plans.validate import validate
from .sources.context import load_context
from .sources.tables import open_source


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarrymill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _validate(a) -> int:
    errors = validate(M.load(a.document))
    print("\n".join(errors) or "valid")
    return int(bool(errors))


def _init(a) -> int:
    print(X.grants(a.kind, **dict(x.split("=", 1) for x in a.names)))
    return 0


def _infer(a) -> int:
    spark = _spark()
    doc, report = infer(spark, open_source(spark, a.source), a.name, context=load_context(a.context) if a.context else None, key_suffixes=tuple(a.key_suffix))
    M.save(doc, a.out)
    Path(f"{a.out}.report.json").write_text(json.dumps(report.as_dict(), indent=2))
    errors = validate(doc)
    print("\n".join(errors) or f"{a.out}: {report.counts}")
    return int(bool(errors))


def _review(a) -> int:
    doc = M.load(a.document)
    if a.verdicts:
        done = apply_verdicts(doc, json.loads(Path(a.verdicts).read_text()))
        M.save(doc, a.document)
        print(f"applied {len(done)}")
        return 0
    items = collect(doc)
    print("\n".join(json.dumps(i) for i in items))
    return int(bool(items))


def _tools(a) -> int:
    """One JSON call a line on standard input: {tool, arguments}."""
    known = tools(M.load(a.document))
    for line in sys.stdin:
        call = json.loads(line)
        print(json.dumps(known[call["tool"]](**call.get("arguments", {})) if call.get("tool") in known else {"error": "unknown tool", "tools": sorted(known)}), flush=True)
    return 0


def _serve(a) -> int:
    """A tool server on standard input and output."""
    for reply in serve(M.load(a.document), sys.stdin):
        print(reply, flush=True)
    return 0


def _drift(a) -> int:
    spark = _spark()
    doc, source = M.load(a.document), open_source(spark, a.source)
    live = {(t.qualified if t.schema else t.name): t.rendered() for t in source.tables()}
    change = D.apply(doc, D.diff(D.baseline(doc), live) + D.semantic(doc, source, live, date.fromisoformat(a.today) if a.today else None))
    if a.questions:
        for name in live:
            source.df(name).createOrReplaceTempView(name.rpartition(".")[2])
        change.failing = D.regressions(spark, json.loads(Path(a.questions).read_text()), change.radius)
    if a.apply:
        M.save(doc, a.document)
    print(D.render(change))
    return int(bool(change.events))


def _compile(a) -> int:
    out = compile_metric(M.load(a.document), a.metric, a.group_by or None, a.grain, a.start, a.end, a.filter, a.calendar)
    print(out.sql if isinstance(out, Compiled) else json.dumps({"refused": out.reason, "group_bys": out.group_bys, "grains": out.grains}, indent=2))
    return int(not isinstance(out, Compiled))


def _export(a) -> int:
    made, losses = X.export_dbt(M.load(a.document))
    Path(a.out).write_text(json.dumps(made, indent=2) if M.yaml is None or a.out.endswith(".json") else M.yaml.safe_dump(made, sort_keys=False))
    print("\n".join(f"lost: {x}" for x in losses))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrymill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, f, *args: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=f)
        for names, kw in args:
            c.add_argument(*names, **kw)

    doc = (("document",), {})
    command("validate", _validate, doc)
    command("init", _init, (("kind",), {}), (("names",), {"nargs": "*"}))
    command("infer", _infer, (("source",), {}), (("--out",), {"default": "semantic.yaml"}), (("--name",), {"default": "warehouse"}), (("--context",), {"action": "append", "default": []}), (("--key-suffix",), {"action": "append", "default": []}))
    command("review", _review, doc, (("--verdicts",), {}))
    command("tools", _tools, doc)
    command("serve", _serve, doc)
    command("drift", _drift, doc, (("source",), {}), (("--questions",), {}), (("--today",), {}), (("--apply",), {"action": "store_true"}))
    command("compile", _compile, doc, (("metric",), {}), (("--group-by",), {"action": "append", "default": []}), *[((f"--{x}",), {}) for x in ("grain", "start", "end", "filter", "calendar")])
    command("export", _export, doc, (("--out",), {"default": "dbt.yaml"}))
    a = p.parse_args(argv)
    try:
        return a.run(a)
    except EngineError as e:
        print(e.render(), file=sys.stderr)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())
