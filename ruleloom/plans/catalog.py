"""All registered queries of the evaluation engine and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("accuracy", "routing", "validation", "paired", "latency", "calibration", "audit", "sampling", "dedup", "engine", "lookups", "planning", "policies", "verify", "shards", "live", "runs")


def _modules():
    return [importlib.import_module(f"ruleloom.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
