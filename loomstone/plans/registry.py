"""Queries by name with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` as a query over the store-shaped views."""

    def put(f):
        from loomstone.sources.adapters import Views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = f"query_{name}", f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return put


def with_views(sql: str) -> str:
    """``sql`` behind the view definitions that it needs, in order of definition."""
    from .views_sql import VIEWS

    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(body)
    parts = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in need]
    sql = sql.strip()
    recursive = sql[:15].upper().startswith("WITH RECURSIVE")
    if sql[:5].upper() == "WITH ":
        sql = sql[14:].lstrip() if recursive else sql[5:]
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*parts, sql])
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
