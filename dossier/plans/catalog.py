"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import ORACLES, QUERIES, runnable

_MODULES = ["text_queries", "landing_queries", "extraction_queries", "identity_queries", "view_queries", "resolution_queries", "vocabulary_queries", "retrieval_queries", "streaming_queries"]
for _name in _MODULES:
    importlib.import_module(f".{_name}", __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = runnable("a1_reports_per_theme")(spark, sf_dir)
    return every.orderBy(F.desc("report_count"), "theme_id").limit(20)
