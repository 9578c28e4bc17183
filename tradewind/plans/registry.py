"""Names of the queries and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register fn(views) -> DataFrame under its name, with DuckDB SQL: one SELECT over the domain's tables, or more of them before it.

    SQL that starts with RECURSIVE_ has a table that refers to itself.
    """
    from tradewind.plans.views import SQL, Views

    def add(fn):
        key = name or fn.__name__
        _queries[key] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            text, domain = sql.strip(), SQL.rstrip()
            if text.startswith("RECURSIVE_"):
                text, domain = text.removeprefix("RECURSIVE_"), domain.replace("WITH ", "WITH RECURSIVE ", 1)
            _sql[key] = f"{domain}\n{text}" if text.startswith("SELECT") else f"{domain},\n{text}"
        return fn

    return add


def _load() -> None:
    from tradewind.plans import boards, catalogue, cleaning, discovery, facts, holdings, listings, loaders, market, posts, reads, selling, series, shelf, shelves, texts, titles  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict:
    _load()
    return dict(_sql)
