"""How a plan module registers its queries."""

from __future__ import annotations


def registry():
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def register(f):
            queries[name] = f
            if oracle is not None:
                sql[name] = oracle
            return f

        return register

    return queries, sql, query
