"""What a person should look at, and what their verdicts change. Verdicts stay: an item is not asked again."""

from __future__ import annotations

THRESHOLD = 0.7


def collect(doc: dict, threshold: float = THRESHOLD) -> list[dict]:
    """Items of four kinds: unsure columns, guessed decodes, unsure relationships, conflicts."""
    out = []
    for t in doc["tables"]:
        for c in t["columns"]:
            at = f"{t['name']}.{c['name']}"
            if c.get("lifecycle") == "inferred" and c.get("confidence", 1) < threshold:
                out.append({"id": f"type:{at}", "kind": "type", "now": c["semantic_type"], "confidence": c["confidence"]})
            out += [{"id": f"decode:{at}:{v['value']}", "kind": "decode", "now": v.get("meaning")} for v in c.get("enum_values", []) if v.get("decode_source") == "llm_guess"]
            out += [{"id": f"conflict:{at}:{i}", "kind": "conflict", "now": x["detail"]} for i, x in enumerate(c.get("conflicts", [])) if not x.get("resolved")]
    out += [{"id": f"relationship:{r['name']}", "kind": "relationship", "now": r["lifecycle"], "confidence": r.get("confidence", 1)} for r in doc.get("relationships", []) if r.get("lifecycle") == "inferred" and r.get("confidence", 1) < threshold]
    return out


def apply(doc: dict, verdicts: dict[str, dict]) -> list[str]:
    """{item id: {verdict: accept | reject | change, value}}; the ids that were applied."""
    columns = {f"{t['name']}.{c['name']}": c for t in doc["tables"] for c in t["columns"]}
    done = []
    for item, said in verdicts.items():
        kind, _, rest = item.partition(":")
        verdict, value = said.get("verdict"), said.get("value")
        if kind == "relationship":
            r = next((r for r in doc.get("relationships", []) if r["name"] == rest), None)
            if r is None:
                continue
            if verdict == "reject":
                doc["relationships"].remove(r)
                for c in r["from"]["columns"]:
                    columns[f"{r['from']['table']}.{c}"].pop("foreign_key", None)
            else:
                r |= {"lifecycle": "reviewed", "confidence": 1.0}
            done.append(item)
            continue
        at, _, which = (rest, "", "") if kind == "type" else rest.rpartition(":")
        c = columns.get(at)
        if c is None:
            continue
        if kind == "type":
            if verdict == "change":
                c["semantic_type"] = value
            elif verdict == "reject":
                c["semantic_type"] = "unknown"
            c |= {"lifecycle": "reviewed", "confidence": 1.0}
            c.setdefault("provenance", []).append({"signal": "human", "detail": verdict})
        elif kind == "decode":
            v = next((v for v in c.get("enum_values", []) if str(v["value"]) == which), None)
            if v is None:
                continue
            if verdict == "reject":
                v.pop("meaning", None)
                v.pop("decode_source", None)
            else:
                v |= {"meaning": value or v.get("meaning"), "decode_source": "human"}
        elif kind == "conflict" and int(which) < len(c.get("conflicts", [])):
            c["conflicts"][int(which)]["resolved"] = value or verdict
        else:
            continue
        done.append(item)
    return done
