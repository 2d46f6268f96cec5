"""Named plans. Each has a Spark build function and, where SQL can say the same, a DuckDB twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from querylore.sources.tables import Tables
from querylore.sources.views import with_views

MODULES = (
    "relational", "scalars", "reports", "catalog", "query_log", "query_pages", "chunks",
    "retrieval", "routing", "sessions", "feedback", "quality", "storage", "streams",
)


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


_PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _PLANS:
            raise ValueError(f"plan {name} is registered twice")
        _PLANS[name] = Plan(name, build, with_views(sql) if sql else None)
        return build

    return register


def all_plans() -> dict[str, Plan]:
    for module in MODULES:
        importlib.import_module(f"querylore.plans.{module}")
    return dict(sorted(_PLANS.items()))
