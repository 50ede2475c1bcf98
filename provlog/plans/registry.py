"""Registered queries by name, and the SQL of the tables they derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provlog.vocabulary import LOG, MAGIC, PROV

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLE_SQL[key] = sql
        return query

    return add


F1 = """WITH f0 AS (SELECT user_id, event_id, event_type, value, json_extract_string(props, '$.k') AS k, 'urn:log:u' || user_id || ':all' AS segment, 'urn:inst:u' || user_id AS instance,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS time, epoch_us(ts) // 1000 AS ms,
    CASE event_type WHEN 'click' THEN 'Resolution' WHEN 'view' THEN 'CacheHit' WHEN 'purchase' THEN 'Access' WHEN 'signup' THEN 'Message' ELSE 'Error' END AS name,
    'urn:event:' || event_id AS subject, CASE WHEN event_type = 'signup' THEN 'anon' ELSE 'urn:agent:a' || (event_id % 7) END AS principal FROM events),
    f1 AS (SELECT *, list_filter(['seq=' || seq, 'principal=' || principal, 'span=' || seq, CASE WHEN seq // 2 >= 1 THEN 'parent=' || (seq // 2) END, 'dur=' || CAST(floor(value) AS BIGINT), 'cap=urn:cap:' || event_type, 'k=' || k,
        CASE WHEN name IN ('Message', 'Error') THEN 'msg=event ' || event_id END], lambda x: x IS NOT NULL) AS kvs,
    time || ' log:' || name || ' ' || subject || ' seq=' || seq || ' principal=' || principal || ' span=' || seq || CASE WHEN seq // 2 >= 1 THEN ' parent=' || (seq // 2) ELSE '' END || ' dur=' || CAST(floor(value) AS BIGINT)
        || ' cap=urn:cap:' || event_type || coalesce(' k=' || k, '') || CASE WHEN name IN ('Message', 'Error') THEN ' msg="event ' || event_id || '"' ELSE '' END AS line FROM f0) """
F2 = (
    F1
    + f""", f2h AS (SELECT user_id, segment, instance, ['error', 'warn', 'info', 'debug', 'trace'][CAST(user_id % 5 AS INT) + 1] AS level, min(time) AS started FROM f1 GROUP BY user_id, segment, instance),
    f2 AS (SELECT *, '{MAGIC}' || chr(10) || '@prefix log:  <{LOG}> .' || chr(10) || '@prefix prov: <{PROV}> .' || chr(10) || '@name     ' || segment || chr(10) || '@instance ' || instance || chr(10)
        || '@level    log:' || level || chr(10) || '@started  ' || started || chr(10) || '@prev     genesis' || chr(10) || chr(10) AS header FROM f2h) """
)
