"""All queries of the library's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import combat_queries, exit_queries, library_queries, match_queries, motion_queries, roster_queries, small_queries, suppression_queries, telemetry_queries, track_queries

MODULES = (match_queries, telemetry_queries, combat_queries, motion_queries, library_queries, track_queries, roster_queries, small_queries, exit_queries, suppression_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        if twice := out.keys() & m.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in m.SQL.items()}
