"""The registered queries of this subpackage and their SQL, by the names the driver uses."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "q_toxicity",
    "q_lines",
    "q_licenses",
    "q_language",
    "q_neardup",
    "q_packing",
    "q_media",
    "q_substring",
    "q_lm",
    "q_decontam",
)


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
