"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans import matrix_queries, sequence_queries, signal_queries, tile_queries

FLAGSHIP = "canonical_validate"
_MODULES = (sequence_queries, matrix_queries, signal_queries, tile_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
