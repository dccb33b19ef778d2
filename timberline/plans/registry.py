"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its expected result as SQL if SQL can state it."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


# The log view over ``events`` in SQL, for use in oracles.
LOGS = """
logs AS (
  SELECT event_id, value, user_id, event_type,
         '00000000-0000-7000-8000-' || lpad(lower(to_hex(event_id)), 12, '0') AS id,
         date_trunc('millisecond', ts) AS ts,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
              WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         'svc-' || CAST(user_id % 8 AS VARCHAR) AS service,
         event_type || ' by user_' || CAST(user_id AS VARCHAR) || ' 100% done' AS message,
         props AS attributes,
         json_extract_string(props, '$.k') AS k
  FROM events
)"""


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


WIRE = f"id, {iso('ts')} AS \"timestamp\", level, service, message, attributes"


def bucket(interval: str, expression: str = "ts") -> str:
    return iso(f"time_bucket(INTERVAL '{interval}', {expression})")
