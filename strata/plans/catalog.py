"""All queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans import pipeline_queries, retrieval_queries, skew_queries, unit_queries

_MODULES = (retrieval_queries, pipeline_queries, skew_queries, unit_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for m in _MODULES for n, q in m.QUERIES.items()}
SQL: dict[str, str] = {n: s for m in _MODULES for n, s in m.SQL.items()}
FLAGSHIP = "hybrid_v2"
