"""The query registry and helpers to write comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COMPARISON_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the comparison text over the named views."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            COMPARISON_SQL[name] = with_views(sql, *views) if views else sql.strip()
        return build

    return register


def greedy(seconds: float, candidates: str, columns: str) -> str:
    """Comparison SQL of the cooldown: follow the chain of alerts per key ``k`` step by step.

    ``candidates`` selects ``k, ts, pkt_id`` and whatever ``columns`` use.
    """
    return f""",
cand AS MATERIALIZED ({candidates}),
fired AS (
  SELECT k, min(ts) AS ts FROM cand GROUP BY k
  UNION ALL
  SELECT c.k, min(c.ts) FROM fired f JOIN cand c ON c.k = f.k AND c.ts >= f.ts + {seconds} GROUP BY c.k),
picked AS (
  SELECT c.* FROM cand c JOIN fired f ON c.k = f.k AND c.ts = f.ts
  QUALIFY row_number() OVER (PARTITION BY c.k, c.ts ORDER BY c.pkt_id) = 1)
SELECT {columns} FROM picked"""
