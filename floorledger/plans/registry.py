"""All registered queries: a Spark job and, where it can be said in SQL, the statement it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("changelist", "text", "spatial", "graphs", "buildings", "evaluation", "drawings")

_QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(fn, sql)
        return fn

    return add


def load() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"floorledger.plans.{family}")
    return dict(sorted(_QUERIES.items()))
