"""Where plans register themselves: by the function's name, with the SQL that says the same, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}

#: The catalogue view over the events table; see catalogue() in tidewatch.sources.tables.
CATALOGUE_SQL = """cat AS (
  SELECT event_id, epoch_us(ts) AS onset_us, 'm' || CAST(user_id % 6 + 1 AS VARCHAR) AS mooring,
    CASE WHEN event_type IN ('click', 'view') THEN 'low' WHEN event_type = 'purchase' THEN 'mid' ELSE 'high' END AS band,
    event_type, value AS snr, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS duration_s,
    epoch_us(ts) + CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000000 AS BIGINT) AS end_us,
    epoch_us(ts) // 14400000000 AS file_number
  FROM events)"""


def plan(sql: str | None = None) -> Callable[[Plan], Plan]:
    """sql: a SELECT, or more common table expressions and a SELECT, that may use the catalogue as cat."""

    def register(f: Plan) -> Plan:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if "cat" in body.replace("(", " ").replace(")", " ").replace(",", " ").split():
                body = f"WITH RECURSIVE {CATALOGUE_SQL}{',' if body[:6].upper() != 'SELECT' else ''} {body}"
            elif body[:6].upper() != "SELECT":
                body = f"WITH RECURSIVE {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return register
