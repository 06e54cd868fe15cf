"""Delayed messages, routes, clients and brokers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import subjects
from tidelog.operators import delay, routing
from tidelog.plans.base import LOGS, query
from tidelog.sources import logs


def _now():
    return F.lit("1998-03-01 05:20:00").cast("timestamp_ntz")


def _scheduled(spark, sf):
    return delay.bucketed(logs.delayed(spark, sf))


@query(LOGS + "SELECT bucket, seq, subject FROM delayed WHERE (seq - 1) % 4 = 0")
def j8_undispatched(spark, sf):
    return delay.undispatched(_scheduled(spark, sf), delay.bucketed(logs.dispatched(spark, sf))).select("bucket", "seq", "subject")


@query(LOGS + "SELECT seq, subject, create_time FROM delayed WHERE seq % 100 = 1")
def j9_schedule_payloads(spark, sf):
    index = logs.delayed(spark, sf).filter("seq % 100 IN (1, 2)").select(F.when(F.col("seq") % 100 == 1, F.col("seq")).otherwise(-F.col("seq")).alias("seq"))  # half of it has no message
    return delay.payloads(index, logs.delayed(spark, sf)).select("seq", "subject", "create_time")


@query(LOGS + "SELECT seq, CAST(ceil(greatest(epoch_ms(schedule_time) - epoch_ms(TIMESTAMP '1998-03-01 05:20:00'), 0) / 500.0) AS BIGINT) AS tick FROM delayed WHERE bucket BETWEEN 199803010000 AND 199803020000")
def p17_wheel_ticks(spark, sf):
    due = _scheduled(spark, sf).filter("bucket BETWEEN 199803010000 AND 199803020000")
    return delay.ticks(due, _now()).select("seq", "tick")


@query(LOGS + "SELECT bucket, count(*) AS n FROM delayed WHERE bucket <= 199803010500 GROUP BY 1")
def p18_load_ahead(spark, sf):
    return delay.loadable(_scheduled(spark, sf), _now()).groupBy("bucket").agg(F.count("*").alias("n"))


@query(LOGS + "SELECT seq, bucket < 199803010500 OR (bucket = 199803010500 AND seq <= 900) AS direct FROM delayed")
def p19_late_insert(spark, sf):
    return delay.added_directly(_scheduled(spark, sf), 199803010500, 900).select("seq", "direct")


@query(LOGS + "SELECT seq, CASE WHEN seq % 5 = 0 THEN 'again' ELSE 'dispatched' END AS outcome FROM delayed")
def p20_dispatch_outcome(spark, sf):
    batch = logs.delayed(spark, sf)
    return delay.after_send(batch, batch.filter("seq % 5 = 0")).select("seq", "outcome")


@query(LOGS + "SELECT DISTINCT bucket FROM delayed WHERE bucket < 199802260500")
def p27_retention(spark, sf):
    return delay.expired_buckets(_scheduled(spark, sf), _now(), 72)


@query(LOGS + "SELECT subject, count(*) AS n, CAST(max(epoch_ms(schedule_time) - epoch_ms(create_time)) AS BIGINT) AS longest FROM delayed GROUP BY 1")
def a16_delay_accuracy(spark, sf):
    from tidelog.functions.attrs import millis

    late = millis(F.col("schedule_time")) - millis(F.col("create_time"))
    return logs.delayed(spark, sf).groupBy("subject").agg(F.count("*").alias("n"), F.max(late).alias("longest"))


@query(LOGS + "SELECT subject, group_name, broker_state FROM routed")
def j10_routes(spark, sf):
    return routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf)).select("subject", "group_name", "broker_state")


_WANTED = "(VALUES ('click', 'tag1'), ('view', 'tag9'), ('error', 'tag3')) w(subject, tag)"


@query(LOGS + f"SELECT w.subject, g.group_name FROM {_WANTED} JOIN broker_groups g ON g.tag = CASE WHEN w.tag = 'tag9' THEN 'tag0' ELSE w.tag END WHERE broker_state <> 4")
def j11_tag_routing(spark, sf):
    wanted = spark.createDataFrame([("click", "tag1"), ("view", "tag9"), ("error", "tag3")], "subject string, tag string")
    return routing.available(wanted, logs.broker_groups(spark, sf), "tag0")


@query(LOGS + "SELECT r.subject, g.group_name FROM routes r, broker_groups g WHERE NOT list_contains(r.names, g.group_name)")
def j12_idle_groups(spark, sf):
    return routing.idle_groups(logs.routes(spark, sf), logs.broker_groups(spark, sf))


@query(LOGS + "SELECT subject, group_name FROM routed WHERE NOT (subject = 'click' AND group_name = 'NATION_0') AND group_name <> 'NATION_4'")
def j13_readonly_groups(spark, sf):
    readonly = spark.createDataFrame([("click", "NATION_0"), ("*", "NATION_4"), ("error", "NATION_0")], "subject string, group_name string")
    return routing.writable(routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf)), readonly).select("subject", "group_name")


_STATES = [("Customer#000000003", "signup", "g1", "offline"), ("*", "error", "g0", "offline"), ("Customer#000000005", "*", "*", "away"), ("Customer#000000003", "*", "*", "away")]
_STATE_SQL = """, stated AS (SELECT *, CASE WHEN client_id = 'Customer#000000003' AND subject = 'signup' AND "group" = 'g1' THEN 'offline' WHEN subject = 'error' AND "group" = 'g0' THEN 'offline'
    WHEN client_id IN ('Customer#000000003', 'Customer#000000005') THEN 'away' ELSE 'online' END AS state FROM clients)
"""


def _states(spark):
    return spark.createDataFrame(_STATES, "client_id string, subject string, group string, state string")


@query(LOGS + _STATE_SQL + "SELECT client_id, subject, state FROM stated")
def j14_client_state(spark, sf):
    return routing.client_states(logs.clients(spark, sf), _states(spark)).select("client_id", "subject", "state")


@query("""WITH b AS (SELECT 'B_' || (s_suppkey // 3) AS group_name, CASE s_suppkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'slave' ELSE 'backup' END AS role, s_name AS address FROM supplier)
SELECT b.group_name, b.role, b.address, p.address AS peer FROM b LEFT JOIN b p ON p.group_name = b.group_name AND p.role = CASE b.role WHEN 'slave' THEN 'master' WHEN 'backup' THEN 'slave' END""")
def j15_sync_peers(spark, sf):
    key = F.col("s_suppkey")
    role = F.when(key % 3 == 0, "master").when(key % 3 == 1, "slave").otherwise("backup")
    brokers = logs.read(spark, sf, "supplier").select(F.concat(F.lit("B_"), F.floor(key / 3)).alias("group_name"), role.alias("role"), F.col("s_name").alias("address"))
    return routing.sync_peers(brokers).select("group_name", "role", "address", "peer")


@query(LOGS + _STATE_SQL + "SELECT s.client_id, r.group_name, s.state FROM stated s JOIN routed r USING (subject) WHERE r.broker_state <> 4 AND NOT (s.client_type = 'producer' AND r.group_name = 'NATION_4')")
def j16_register_response(spark, sf):
    route = routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf)).filter(F.col("broker_state") != routing.NEITHER)
    known = routing.client_states(logs.clients(spark, sf), _states(spark))
    readonly = spark.createDataFrame([("*", "NATION_4")], "subject string, group_name string")
    reading = known.filter("client_type = 'consumer'").join(route, "subject")
    writing = known.filter("client_type = 'producer'").join(routing.writable(route, readonly), "subject")
    return reading.unionByName(writing).select("client_id", "group_name", "state")


@query(LOGS + "SELECT client_id, (SELECT string_agg(group_name, ' ' ORDER BY group_name) FROM broker_groups WHERE kind = 'delay') AS groups FROM clients WHERE client_type = 'producer'")
def j17_delay_routes(spark, sf):
    route = routing.delay_route(logs.clients(spark, sf), logs.broker_groups(spark, sf))
    return route.select("client_id", F.array_join("groups", " ").alias("groups"))


@query(LOGS + "SELECT subject, group_name, row_number() OVER (PARTITION BY subject ORDER BY group_name) - 1 AS index FROM routed WHERE broker_state IN (1, 3)")
def j18_visible_route(spark, sf):
    route = routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf))
    return routing.visible(route, "consumer").select("subject", "group_name", F.col("index").cast("long").alias("index"))


@query(LOGS + "SELECT group_name, 'http://host' || group_key || ':' || CASE WHEN group_key % 2 = 0 THEN 9000 + group_key ELSE 8080 END AS address FROM broker_groups")
def j19_slave_addresses(spark, sf):
    groups = logs.broker_groups(spark, sf)
    ports = groups.filter("group_key % 2 = 0").select("group_name", (F.col("group_key") + 9000).alias("port"))
    found = groups.join(ports, "group_name", "left")
    return found.select("group_name", F.concat(F.lit("http://host"), "group_key", F.lit(":"), F.coalesce("port", F.lit(8080))).alias("address"))


@query(LOGS + "SELECT group_name, 'b' || group_key AS master, CASE WHEN group_key % 3 = 0 THEN 0 ELSE group_key * 2 END AS failures FROM broker_groups")
def j20_refresh_merge(spark, sf):
    groups = logs.broker_groups(spark, sf)
    new = groups.select("group_name", F.concat(F.lit("b"), "group_key").alias("master"))
    old = groups.select("group_name", F.concat(F.when(F.col("group_key") % 3 == 0, "old").otherwise("b"), "group_key").alias("master"), (F.col("group_key") * 2).alias("failures"))
    return routing.merged_groups(old, new)


@query(LOGS + """SELECT subject, "group", string_agg(client_id, ' ' ORDER BY client_id) AS endpoints FROM clients WHERE client_type = 'consumer' GROUP BY 1, 2""")
def a13_h6_consumers(spark, sf):
    found = routing.consumers_of(logs.clients(spark, sf), F.col("client_id"))
    return found.select("subject", "group", F.array_join("endpoints", " ").alias("endpoints"))


@query(LOGS + "SELECT app_code, subject, count(DISTINCT room) AS rooms FROM clients WHERE client_type = 'consumer' GROUP BY 1, 2 HAVING count(DISTINCT room) > 1")
def a14_spread_consumers(spark, sf):
    return routing.spread(logs.clients(spark, sf))


@query(LOGS + "SELECT group_name, count(*) AS n FROM messages m JOIN routed r ON r.subject = m.subject AND r.group_key % 2 = m.k % 2 GROUP BY 1")
def a15_grouped_by_route(spark, sf):
    route = routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf)).select("subject", "group_name", (F.col("group_key") % 2).alias("part"))
    rows = logs.messages(spark, sf).select("subject", (F.col("k") % 2).alias("part"))
    return rows.join(route, ["subject", "part"]).groupBy("group_name").agg(F.count("*").alias("n"))


@query(LOGS + "SELECT subject, max(create_time) < TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 5 SECOND AS read_only FROM messages GROUP BY 1")
def a17_slave_lag(spark, sf):
    late = F.max("create_time") < F.lit("2024-01-30 23:30:00").cast("timestamp_ntz") - F.expr("INTERVAL 5 SECONDS")
    return logs.messages(spark, sf).groupBy("subject").agg(late.alias("read_only"))


@query(LOGS + "SELECT CAST(user_id AS VARCHAR) AS client_id, max(create_time) AS last_seen FROM messages GROUP BY 1 HAVING max(create_time) >= TIMESTAMP '2024-01-30 23:40:00' - INTERVAL 200 SECOND")
def p14_alive_clients(spark, sf):
    beats = logs.messages(spark, sf).select(F.col("user_id").cast("string").alias("client_id"), F.col("create_time").alias("ts"))
    return routing.alive(beats, F.lit("2024-01-30 23:40:00").cast("timestamp_ntz"))


@query(LOGS + """SELECT user_id, max(create_time) AS last_seen, CASE WHEN TIMESTAMP '2024-01-31' - max(create_time) >= INTERVAL 2 DAY THEN 'forever' WHEN TIMESTAMP '2024-01-31' - max(create_time) >= INTERVAL 3 MINUTE THEN 'offline' ELSE 'online' END AS status FROM messages GROUP BY 1""")
def p12_consumer_liveness(spark, sf):
    beats = logs.messages(spark, sf).select("user_id", F.col("create_time").alias("ts"))
    return routing.liveness(beats, ["user_id"], F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query(LOGS + "SELECT subject AS group_name, CAST(CASE WHEN max(create_time) < TIMESTAMP '2024-01-30 23:40:00' - INTERVAL 30 SECOND THEN 4 ELSE 1 END AS BIGINT) AS state FROM messages GROUP BY 1")
def p13_group_heartbeats(spark, sf):
    beats = logs.messages(spark, sf).select(F.col("subject").alias("group_name"), F.col("create_time").alias("ts"))
    return routing.heartbeat_states(beats, F.lit("2024-01-30 23:40:00").cast("timestamp_ntz"))


@query(LOGS + "SELECT client_id, CAST(client_key % 8 AS BIGINT) = 7 AS switched_on FROM clients")
def p31_client_switch(spark, sf):
    bits = F.col("client_key") % 8
    return logs.clients(spark, sf).select("client_id", (bits == 7).alias("switched_on"))


@query(LOGS + "SELECT message_id, subject, k FROM messages WHERE k % 2 = 0")
def p34_old_clients(spark, sf):
    return logs.messages(spark, sf).filter("k % 2 = 0").drop("tags").select("message_id", "subject", "k")


@query(LOGS + "SELECT subject, array_to_string(list_sort(list_distinct(list_filter(list_concat(names, ['NATION_0', 'NATION_20']), lambda x: x <> 'NATION_3'))), ' ') AS names FROM routes")
def u2_u4_route_changes(spark, sf):
    rows = logs.routes(spark, sf).select("subject", F.from_json("broker_groups", "array<string>").alias("names"))
    changed = routing.extended(rows, F.array(F.lit("NATION_0"), F.lit("NATION_20")), F.array(F.lit("NATION_3")))
    return changed.select("subject", F.array_join("names", " ").alias("names"))


@query(LOGS + "SELECT DISTINCT 'real' AS kind, subject FROM messages UNION ALL SELECT 'retry', '%RETRY%' || subject || '%g0' FROM (SELECT DISTINCT subject FROM messages)")
def u3_u6_union_and_dedupe(spark, sf):
    rows = logs.messages(spark, sf).select("subject").distinct()
    again = rows.select(F.lit("retry").alias("kind"), subjects.retry_subject(F.col("subject"), F.lit("g0")).alias("subject"))
    return rows.select(F.lit("real").alias("kind"), "subject").unionByName(again)
