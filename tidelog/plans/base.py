"""Registration of queries with their SQL, and the derived logs in SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the DuckDB SQL for its rows."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


#: The logs of tidelog.sources.logs as common table expressions.
LOGS = """WITH messages AS (
    SELECT event_type AS subject, event_id AS "offset", 'm' || event_id AS message_id, ts AS create_time, user_id, value, k,
        ['k' || (k % 3), 'p' || (k % 5)] AS tags, k % 6 + 1 AS times, CAST(3 AS BIGINT) AS max_retry,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), blocks AS (
    SELECT subject, seq // 20 AS block, min(seq) AS first_msg, max(seq) AS last_msg, max(create_time) AS ts FROM messages GROUP BY 1, 2
), pulls AS (
    SELECT subject, g AS "group", 'c' || (block % 3) AS consumer_id, block, first_msg, last_msg, ts,
        block // 3 * 20 AS first_pull, block // 3 * 20 + last_msg - first_msg AS last_pull
    FROM blocks, (VALUES ('g0'), ('g1')) x(g)
), acks AS (
    SELECT subject, "group", consumer_id, block, ts, first_pull, last_pull, again
    FROM pulls, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) x(again) WHERE block % 7 <> 3 AND (again = 0 OR block % 11 = 5)
), deliveries AS (
    SELECT subject, "group", consumer_id, first_pull + i AS pull_seq, first_msg + i AS seq, ts AS pull_ts
    FROM pulls, (SELECT unnest(range(20)) AS i) WHERE i <= last_pull - first_pull
), progress AS (
    SELECT p.subject, p."group", p.consumer_id, p.pull, coalesce(a.ack, -1) AS ack
    FROM (SELECT subject, "group", consumer_id, max(last_pull) AS pull FROM pulls GROUP BY ALL) p
    LEFT JOIN (SELECT subject, "group", consumer_id, max(last_pull) AS ack FROM acks GROUP BY ALL) a USING (subject, "group", consumer_id)
), delayed AS (
    SELECT o_orderkey + 1 AS seq, o_orderpriority AS subject, CAST(o_orderdate AS TIMESTAMP) AS create_time,
        CAST(o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) AS TIMESTAMP) AS schedule_time,
        CAST(strftime(o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)), '%Y%m%d%H00') AS BIGINT) AS bucket
    FROM orders
), dispatched AS (SELECT * FROM delayed WHERE (seq - 1) % 4 <> 0
), clients AS (
    SELECT c_name AS client_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS subject, 'g' || (c_custkey % 2) AS "group",
        c_mktsegment AS app_code, 'room' || (c_nationkey % 3) AS room, CASE WHEN c_custkey % 4 = 0 THEN 'producer' ELSE 'consumer' END AS client_type, c_custkey AS client_key
    FROM customer
), broker_groups AS (
    SELECT n_name AS group_name, CASE WHEN n_nationkey % 6 = 5 THEN 'delay' ELSE 'real' END AS kind, 'tag' || n_regionkey AS tag,
        CAST(CASE WHEN n_nationkey % 9 = 0 THEN 4 WHEN n_nationkey % 5 = 1 THEN 3 ELSE 1 END AS BIGINT) AS broker_state, CAST(n_nationkey AS BIGINT) AS group_key
    FROM nation
), routes(subject, names) AS (
    VALUES ('click', ['NATION_0', 'NATION_1', 'NATION_40']), ('error', ['NATION_3', 'NATION_4', 'NATION_41']), ('purchase', ['NATION_6', 'NATION_7', 'NATION_42']),
        ('signup', ['NATION_9', 'NATION_10', 'NATION_43']), ('view', ['NATION_12', 'NATION_13', 'NATION_44'])
), routed AS (
    SELECT r.subject, g.* FROM (SELECT subject, unnest(names) AS group_name FROM routes) r JOIN broker_groups g USING (group_name)
)
"""
