"""The registered queries and their SQL."""

from __future__ import annotations

from .views import SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None, *views: str, recursive: bool = False):
    """Registers a query under its function's name, with SQL that may use the named views."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLE_SQL[run.__name__] = (head + ",\n".join(SQL[v] for v in views) + "\n" if views else "") + sql
        return run

    return register
