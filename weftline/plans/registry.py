"""All driver queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import analytics, introspected, metadata, passthrough, retrieval, statistics, telemetry

FLAGSHIP = "hybrid_search"
MODULES = (retrieval, statistics, metadata, introspected, telemetry, passthrough, analytics)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.BOOK.queries
    ORACLES |= _module.BOOK.oracles
