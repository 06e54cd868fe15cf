"""History tables, lookups in runs, pulls and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.operators import delivery, progress, store
from tidelog.plans.base import LOGS, query
from tidelog.plans.log_queries import _CODES, _coded
from tidelog.plans.progress_queries import _C, _CONSUMER, _RECORDS
from tidelog.sources import logs


@query(LOGS + "SELECT seq, subject, create_time, schedule_time FROM delayed WHERE seq >= 200 AND seq < 400")
def src5_delay_log_scan(spark, sf):
    return logs.scan_between(logs.delayed(spark, sf).withColumn("offset", F.col("seq")), 200, 400).drop("offset")


@query(_CODES + "SELECT message_id, value FROM dated WHERE code || inverted || md5(message_id) = (SELECT min(code || inverted || md5(message_id)) FROM dated WHERE subject = 'view' AND seq = 4)")
def src13_key_get(spark, sf):
    key = keys.message_key(F.col("code"), F.col("create_time"), F.col("message_id"))
    rows = _coded(spark, sf).withColumn("row_key", key)
    wanted = rows.filter("subject = 'view' AND seq = 4").select("row_key")
    return rows.join(wanted, "row_key", "left_semi").select("message_id", "value")


@query(LOGS + "SELECT group_name, kind, tag, broker_state FROM broker_groups")
def src15_metadata_scan(spark, sf):
    return logs.broker_groups(spark, sf).drop("group_key")


@query(LOGS + f""", pending AS (
    SELECT d.*, pull_seq - row_number() OVER (PARTITION BY {_C} ORDER BY pull_seq) AS island FROM deliveries d JOIN progress p USING ({_C}) JOIN messages m USING (subject, seq)
    WHERE pull_seq > ack - CASE WHEN consumer_id = 'c1' THEN 30 ELSE 0 END AND k % 7 <> 0
), first_runs AS (SELECT {_C}, arg_min(lo, lo) AS lo, arg_min(hi, lo) AS hi FROM (SELECT {_C}, min(pull_seq) AS lo, max(pull_seq) AS hi FROM pending GROUP BY {_C}, island) GROUP BY ALL),
sides AS (SELECT subject, "group", max(last_msg) AS last FROM pulls WHERE block < 9 OR subject = 'view' GROUP BY 1, 2), ends AS (SELECT subject, max(seq) AS top FROM messages GROUP BY 1)
SELECT p.subject, p."group", p.consumer_id, CASE WHEN f.lo IS NOT NULL THEN 'again' WHEN last < top THEN 'new' ELSE 'wait' END AS kind,
    coalesce(f.lo, CASE WHEN last < top THEN last + 1 END) AS lo, coalesce(least(f.lo + 11, f.hi), CASE WHEN last < top THEN least(last + 12, top) END) AS hi
FROM progress p LEFT JOIN first_runs f USING ({_C}) JOIN sides USING (subject, "group") JOIN ends USING (subject)""")
def src17_p1_pull(spark, sf):
    pulls, rows = logs.pulls(spark, sf), logs.messages(spark, sf)
    done = progress.consumer_progress(pulls, logs.acks(spark, sf)).withColumn("ack", F.col("ack") - F.when(F.col("consumer_id") == "c1", 30).otherwise(0))
    groups = progress.group_progress(pulls.filter("block < 9 OR subject = 'view'"))
    return store.pull(done, groups, delivery.deliveries(pulls), rows.filter("k % 7 <> 0").select("subject", "seq"), progress.bounds(rows), 12)


@query(LOGS + "SELECT bucket, count(*) AS n FROM dispatched GROUP BY 1")
def snk8_dispatch_append(spark, sf):
    from tidelog.operators.delay import bucketed

    rows = bucketed(logs.dispatched(spark, sf)).select("bucket", "seq")
    return rows.unionByName(rows.filter("seq % 3 = 0")).distinct().groupBy("bucket").agg(F.count("*").alias("n"))


@query(_RECORDS + """, codes AS (SELECT subject, lpad(CAST(row_number() OVER (ORDER BY subject) AS VARCHAR), 6, '0') AS code FROM (SELECT DISTINCT subject FROM messages))
SELECT code || lpad(CAST(seq AS VARCHAR), 19, '0') || '000007' || CASE "group" WHEN 'g0' THEN '000001' ELSE '000002' END || action AS row_key, consumer_id, pull_seq FROM records JOIN codes USING (subject)""")
def snk12_record_history(spark, sf):
    pulls = logs.pulls(spark, sf)
    rows = delivery.records(pulls, logs.acks(spark, sf))
    return store.record_rows(rows, keys.dictionary(pulls, "subject"), "000007", keys.dictionary(pulls, "group")).select("row_key", "consumer_id", "pull_seq")


@query(LOGS + "SELECT message_id, create_time + INTERVAL 500 MILLISECOND AS died FROM messages WHERE times >= 3")
def snk13_dead_records(spark, sf):
    return logs.messages(spark, sf).filter("times >= 3").select("message_id", store.dead_record_time(F.col("create_time")).alias("died"))


@query(_CODES + "SELECT code || inverted || md5(message_id) AS row_key, seq FROM dated")
def snk14_o9_sorted_load(spark, sf):
    key = keys.message_key(F.col("code"), F.col("create_time"), F.col("message_id"))
    return store.sorted_for_load(_coded(spark, sf).select(key.alias("row_key"), "seq"), "row_key")


@query(LOGS + "SELECT seq, epoch_us(create_time) AS micros, 'b1' AS broker, message_id FROM messages")
def k9_k10_packed_values(spark, sf):
    rows = logs.messages(spark, sf).select(store.packed(F.col("seq"), F.col("create_time"), F.lit("b1"), F.col("message_id")).alias("v"))
    return rows.select(*(c.alias(n) for n, c in store.unpacked(F.col("v")).items()))


@query(_CODES + "SELECT message_id FROM dated WHERE subject = 'click' AND strftime(create_time, '%y%m%d%H%M%S') BETWEEN '240105000000' AND '240110000000'")
def f14_key_ranges(spark, sf):
    """Messages of a time range by their keys: later times have smaller keys."""
    low, high = (keys.inverted_date(F.lit(t).cast("timestamp_ntz")) for t in ("2024-01-10 00:00:00", "2024-01-05 00:00:00"))
    rows = _coded(spark, sf).filter("subject = 'click'").withColumn("row_key", keys.message_key(F.col("code"), F.col("create_time"), F.col("message_id")))
    return rows.filter(F.col("row_key").between(F.concat("code", low), F.concat("code", high, F.lit("g")))).select("message_id")


@query(LOGS + f"SELECT r.subject, r.\"group\", r.consumer_id, r.pull_seq, coalesce(d.seq, -1) AS seq FROM (SELECT * FROM (SELECT DISTINCT {_C} FROM pulls), (SELECT unnest([0, 19, 20, 77, 1000000]) AS pull_seq)) r LEFT JOIN deliveries d USING ({_C}, pull_seq)")
def j2_floor_lookup(spark, sf):
    pulls = logs.pulls(spark, sf)
    places = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 19, 20, 77, 1_000_000))))
    return store.floor_lookup(pulls.select(*_CONSUMER).distinct().withColumn("pull_seq", places), pulls, "pull_seq")


@query(LOGS + "SELECT message_id, subject, seq FROM messages WHERE subject = 'error' AND times >= 3 AND message_id LIKE 'm1%' ORDER BY message_id LIMIT 100")
def j7_dead_record(spark, sf):
    rows = logs.messages(spark, sf).filter("subject = 'error' AND times >= 3").filter(F.startswith("message_id", F.lit("m1")))
    return rows.orderBy("message_id").limit(100).select("message_id", "subject", "seq")


@query(LOGS + 'SELECT subject, start, CASE WHEN start <= 0 THEN low WHEN start > high THEN high ELSE start END AS "from" FROM (SELECT subject, min("offset") AS low, max("offset") AS high FROM messages GROUP BY 1), (SELECT unnest([-5, 0, 90, 100000000]) AS start)')
def p21_replay_start(spark, sf):
    ends = logs.messages(spark, sf).groupBy("subject").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    rows = ends.withColumn("start", F.explode(F.array(*map(F.lit, (-5, 0, 90, 100_000_000)))))
    return rows.select("subject", "start", store.replay_start(F.col("start"), F.col("low"), F.col("high")).alias("from"))


@query(LOGS + """SELECT user_id, list_reduce(list_prepend(CAST(100 AS DOUBLE), list(CASE k % 5 WHEN 0 THEN CAST(0.25 AS DOUBLE) WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 WHEN 3 THEN 1.25 ELSE 1.5 END ORDER BY "offset")),
lambda w, x: least(CAST(150 AS DOUBLE), greatest(CAST(5 AS DOUBLE), w * x))) AS weight FROM messages GROUP BY 1""")
def p28_broker_weights(spark, sf):
    k = F.col("k") % 5
    outcome = F.when(k == 0, "timeout").when(k == 1, "none").when(k == 2, "less").when(k == 3, "more").otherwise("full")
    return store.weights(logs.messages(spark, sf).withColumn("outcome", outcome), ["user_id"], "offset")


@query(LOGS + "SELECT subject, count(*) AS n FROM messages WHERE seq IN (SELECT seq FROM delayed WHERE seq % 3 = 0) GROUP BY 1")
def u5_key_set(spark, sf):
    held = logs.delayed(spark, sf).filter("seq % 3 = 0").select("seq")
    return logs.messages(spark, sf).join(held, "seq", "left_semi").groupBy("subject").agg(F.count("*").alias("n"))
