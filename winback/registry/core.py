from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str, seen: list[str]) -> list[str]:
    for word in re.findall(r"\b[a-z_0-9]+\b", sql):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def expand(sql: str) -> str:
    """Put the shared common table expressions a statement uses in front of it."""
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head},\n{re.sub(r'(?i)^with\s+recursive', '', body)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head},\n{re.sub(r'(?i)^with', '', body)}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            RAW[name] = sql
        return fn
    return register


def finish() -> None:
    """Complete the statements once all modules have named their common table expressions."""
    ORACLES.update({name: expand(sql) for name, sql in RAW.items()})
