"""The derived inputs of ``suite.views`` once more, as DuckDB common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n]}\n)" for n in VIEWS if n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ctes + ",\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ctes + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ctes + "\n" + body
