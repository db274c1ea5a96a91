"""All queries of the core, and their SQL."""

from __future__ import annotations

from strandloom.plans import interval_queries, packed_and_intervals, read_queries, resampling_queries, sequence_queries, source_queries, statistics_queries, streaming_queries, table_queries

_MODULES = (packed_and_intervals, interval_queries, table_queries, sequence_queries, statistics_queries, resampling_queries, read_queries, source_queries, streaming_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
