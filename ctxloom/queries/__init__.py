"""The registered queries: a Spark plan each, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Names of queries, their callables and their SQL."""

    plans: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.plans:
                raise ValueError(f"two queries are named {name}")
            self.plans[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


#: The modules of this folder that hold queries.
MODULES = ("integrity", "search", "textops", "usage", "stores")


def core() -> Registry:
    """All core queries."""
    reg = Registry()
    for m in MODULES:
        importlib.import_module(f"ctxloom.queries.{m}").register(reg)
    return reg
