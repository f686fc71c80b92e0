"""Words in column and table names, and how much two names look like the same key."""

from __future__ import annotations

# Key words that carry no meaning of their own, and abbreviations of warehouse names.
KEY_WORDS = frozenset("id key sk pk cd code no nbr number".split())
ABBREVIATIONS = {
    "acct": "account", "addr": "address", "amt": "amount", "cat": "category", "chnl": "channel", "cmpgn": "campaign", "ctry": "country", "curr": "currency",
    "cust": "customer", "dept": "department", "dt": "date", "emp": "employee", "evt": "event", "inv": "inventory", "mgr": "manager", "mthd": "method",
    "ord": "order", "pmt": "payment", "prod": "product", "promo": "promotion", "rgn": "region", "rsn": "reason", "whs": "warehouse", "wh": "warehouse",
}
KEY_SUFFIXES = ("_id", "_key", "_sk", "_cd", "_code", "_no", "_nbr", "_number")
#: A table prefix of one to three letters may be dropped from a name whose rest is at least this long.
LEAST_CORE = 6


def words(name: str) -> list[str]:
    """Parts of a name, abbreviations spelled out, without a plural s."""
    out = []
    for part in name.lower().split("_"):
        part = ABBREVIATIONS.get(part, part)
        if part:
            out.append(part[:-1] if len(part) > 3 and part.endswith("s") and not part.endswith("ss") else part)
    return out


def has(name: str, *tokens: str) -> bool:
    """Whether one of ``tokens`` stands in the name between underscores or ends."""
    padded = f"_{name.lower()}_"
    return any(f"_{t}_" in padded for t in tokens)


def ends(name: str, *tokens: str) -> bool:
    return any(f"_{name.lower()}".endswith(f"_{t}") for t in tokens)


def looks_like_key(name: str) -> bool:
    return name.lower() == "id" or name.lower().endswith(KEY_SUFFIXES)


def core(name: str) -> str | None:
    """A name without its short table prefix: ``c_custkey`` and ``custkey`` are the same key."""
    prefix, _, rest = name.lower().partition("_")
    return rest if 1 <= len(prefix) <= 3 and len(rest) >= LEAST_CORE else None


def similarity(child: str, parent_table: str, parent: str) -> float:
    """From 1.2 (the same name) down to 0: how much ``child`` looks like a reference to ``parent_table.parent``."""
    a, b = child.lower(), parent.lower()
    if a == b and a != "id":
        return 1.2
    if (core(a) or a) == (core(b) or b) and (core(a) or core(b)):
        return 0.9
    own, other, table = words(a), words(b), words(parent_table)
    meaning = [w for w in own if w not in KEY_WORDS]
    target = [w for w in other if w not in KEY_WORDS] or [w for w in table if w not in ("dim", "ref", "mstr", "master")]
    if meaning and target:
        if meaning[-len(target) :] == target:
            return 0.9
        initials = "".join(w[0] for w in target)
        if len(initials) > 1 and meaning[-1] == initials:
            return 0.95 if len(meaning) == 1 else 0.35
    wanted = set(target) | {w for w in table if w not in KEY_WORDS}
    shared = set(meaning) & wanted
    return round(len(shared) / max(len(set(meaning) | set(target)), 1), 3) if shared else 0.0
