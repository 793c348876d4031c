"""Registry of queries: the Spark plan and, where SQL can say it, its oracle."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    _VIEWS[name] = body.strip()


def _used(text: str) -> list[str]:
    """Views a text refers to, dependencies first."""
    out: list[str] = []

    def visit(t: str) -> None:
        for v, body in _VIEWS.items():
            if v not in out and re.search(rf"\b{v}\b", t):
                visit(body)
                if v not in out:
                    out.append(v)
    visit(text)
    return out


def expand(body: str) -> str:
    body = body.strip()
    m = re.match(r"with(\s+recursive)?\s+", body, re.I)
    views = [f"{v} AS ({_VIEWS[v]})" for v in _used(body)]
    if not views:
        return body
    rest = body[m.end():] if m else None
    head = "WITH RECURSIVE " + ",\n".join(views)
    return f"{head},\n{rest}" if rest else f"{head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = expand(sql)
        return fn
    return add
