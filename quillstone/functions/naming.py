"""Column and table names: parts, base words, abbreviations, and how alike two names are. Names are few; this is plain Python."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

#: Abbreviations and what they stand for. Those of one trade are added by ``add_words`` or learned from the data.
ABBREVIATIONS = {"cust": "customer", "emp": "employee", "dept": "department", "prod": "product", "ord": "order", "supp": "supplier", "addr": "address", "qty": "quantity", "amt": "amount", "acct": "account", "cat": "category", "inv": "invoice", "mgr": "manager", "org": "organization", "loc": "location"}
KEY_WORDS = ("id", "key", "code", "no", "num", "number", "ref", "fk", "pk", "nr")
#: Roles that stand for an entity.
ROLES = {"buyer": "customer", "client": "customer", "manager": "employee", "vendor": "supplier"}
PARENT = re.compile(r"^(parent|manager|supervisor|reports_to|superior|boss)(_|$)|_parent(_|$)|^parent")
TEMPORAL = {"valid": re.compile(r"^(valid|effective|start|end)_?(from|to|date|at)?$"), "current": re.compile(r"^(is_)?(current|active)(_flag)?$"), "version": re.compile(r"^(version|revision|rev)(_no|_number)?$"), "previous": re.compile(r"^(previous|prior|old)_"), "system": re.compile(r"^(sys|transaction|recorded)_"), "snapshot": re.compile(r"^(snapshot|as_of)(_date)?$")}


def add_words(abbreviations: dict[str, str] | None = None, roles: dict[str, str] | None = None) -> None:
    """More abbreviations and roles, as a trade has them."""
    ABBREVIATIONS.update(abbreviations or {})
    ROLES.update(roles or {})


def snake(name: str) -> str:
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name))
    return re.sub(r"[\s\-.]+", "_", parted).lower().strip("_")


def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3 else word


def parts(column: str) -> list[str]:
    """Words of a name: a prefix of one or two letters (as in l_orderkey) goes, key words are split off, abbreviations written out."""
    words = snake(column).split("_")
    if len(words) > 1 and len(words[0]) <= 2 and words[0] not in KEY_WORDS:
        words = words[1:]
    out: list[str] = []
    for w in words:
        cut = next((k for k in KEY_WORDS if len(k) > 1 and w.endswith(k) and len(w) > len(k) + 1), None) if w not in KEY_WORDS else None
        out += [w[: -len(cut)], cut] if cut else [w]
    return [singular(ABBREVIATIONS.get(w, w)) for w in out if w]


def base(column: str) -> str:
    """The entity that a key column names."""
    words = [w for w in parts(column) if w not in KEY_WORDS]
    return "_".join(ROLES.get(w, w) for w in words)


def is_key(column: str) -> bool:
    found = parts(column)
    return bool(found) and found[-1] in KEY_WORDS


def name_similarity(fk: str, pk: str, pk_table: str) -> float:
    """How well a foreign key's name fits a primary key and its table."""
    if snake(fk) == snake(pk):
        return 1.0
    a, b, t = base(fk), base(pk), base(pk_table)
    if a and a == b:
        return 0.95
    if a and a == t:
        return 0.85
    if a and t and (a.endswith("_" + t) or t in a.split("_")):
        return 0.8
    if a and b and (a in b or b in a) and min(len(a), len(b)) > 2:
        return 0.7
    return 0.5 * SequenceMatcher(None, a, b).ratio()


def column_match(a: str, b: str) -> float:
    """1 for equal words, else half token Jaccard, .3 sequence ratio and .2 for the same entity."""
    x, y = parts(a), parts(b)
    if x == y:
        return 1.0
    union = set(x) | set(y)
    jaccard = len(set(x) & set(y)) / len(union) if union else 0.0
    return min(1.0, 0.5 * jaccard + 0.3 * SequenceMatcher(None, "_".join(x), "_".join(y)).ratio() + 0.2 * (base(a) == base(b) != ""))


def table_groups(tables: list[str]) -> dict[str, list[str]]:
    """Tables that share a first word."""
    out: dict[str, list[str]] = {}
    for t in tables:
        out.setdefault(snake(t).split("_")[0], []).append(t)
    return {k: v for k, v in out.items() if len(v) > 1}


def temporal_kind(columns: list[str]) -> str | None:
    """How a table keeps history, by its columns' names."""
    have = {kind for kind, pattern in TEMPORAL.items() for c in columns if pattern.search(snake(c))}
    if {"valid", "system"} <= have:
        return "bitemporal"
    if "valid" in have or {"current", "version"} <= have:
        return "type2"
    if "previous" in have:
        return "type3"
    return "snapshot" if "snapshot" in have else "type1" if have else None
