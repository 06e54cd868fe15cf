"""Progress, deliveries, retries, history and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import subjects
from tidelog.operators import delivery, history, metrics, progress, retry
from tidelog.plans.base import LOGS, query
from tidelog.sources import logs

_C = 'subject, "group", consumer_id'
_CONSUMER = ["subject", "group", "consumer_id"]

def _now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
_RECORDS = LOGS + f""", records AS (
    SELECT subject, seq, "group", consumer_id, pull_seq, CAST(0 AS BIGINT) AS action, pull_ts AS "at" FROM deliveries
    UNION ALL SELECT d.subject, d.seq, d."group", d.consumer_id, d.pull_seq, 1, a.ts FROM acks a JOIN deliveries d USING ({_C}) WHERE d.pull_seq BETWEEN a.first_pull AND a.last_pull
)
"""
_GAPS = LOGS + f""", lost AS (
    SELECT {_C}, lo, hi FROM (SELECT {_C}, coalesce(max(last_pull) OVER w, -1) + 1 AS lo, first_pull - 1 AS hi FROM acks
    WINDOW w AS (PARTITION BY {_C} ORDER BY first_pull, last_pull ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE lo <= hi
)
"""


@query(LOGS + 'SELECT subject, min(seq) AS min_seq, max(seq) AS max_seq, max("offset") AS max_offset FROM messages GROUP BY subject')
def a1_a5_subject_bounds(spark, sf):
    return progress.bounds(logs.messages(spark, sf))


@query(LOGS + 'SELECT subject, "group", max(last_msg) AS max_pulled FROM pulls GROUP BY 1, 2')
def a2_group_progress(spark, sf):
    return progress.group_progress(logs.pulls(spark, sf))


@query(LOGS + "SELECT * FROM progress")
def a3_consumer_progress(spark, sf):
    return progress.consumer_progress(logs.pulls(spark, sf), logs.acks(spark, sf))


@query(LOGS + f"""SELECT {_C}, first_pull, missing FROM (
    SELECT *, first_pull - max(last_pull) OVER (PARTITION BY {_C} ORDER BY first_pull ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS missing FROM acks WHERE again = 0) WHERE missing > 0""")
def a4_gap_detection(spark, sf):
    found = progress.skips(logs.acks(spark, sf).filter("again = 0"), _CONSUMER, "first_pull", "last_pull", "first_pull")
    return found.select(*_CONSUMER, "first_pull", "missing")


@query(LOGS + """SELECT p.subject, p."group", m.last - p.last AS lag FROM (SELECT subject, "group", max(last_msg) AS last FROM pulls WHERE block % 10 < 7 GROUP BY 1, 2) p
JOIN (SELECT subject, max(seq) AS last FROM messages GROUP BY 1) m USING (subject)""")
def a6_consumer_lag(spark, sf):
    return progress.lag(logs.messages(spark, sf), logs.pulls(spark, sf).filter("block % 10 < 7"))


@query(LOGS + f"SELECT {_C}, pull - ack AS unacked FROM progress")
def a7_unacked(spark, sf):
    return progress.unacked(progress.consumer_progress(logs.pulls(spark, sf), logs.acks(spark, sf)))


@query(LOGS + f"""SELECT subject, "group", string_agg(consumer_id || ':' || pull || '/' || ack, ' ' ORDER BY consumer_id) AS consumers FROM progress GROUP BY 1, 2""")
def a3_nested_progress(spark, sf):
    found = progress.nested(progress.consumer_progress(logs.pulls(spark, sf), logs.acks(spark, sf)))
    texts = F.transform(F.array_sort(F.map_entries("consumers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["pull"], F.lit("/"), e["value"]["ack"]))
    return found.select("subject", "group", F.array_join(texts, " ").alias("consumers"))


@query(LOGS + "SELECT subject, user_id, count(*) AS total FROM messages GROUP BY 1, 2")
def a8_counter(spark, sf):
    return metrics.counter(logs.messages(spark, sf), ["subject", "user_id"])


@query(LOGS + "SELECT subject, CAST(date_trunc('minute', create_time) AS TIMESTAMP) AS minute, count(*) AS marks, CAST(sum(k) AS BIGINT) AS amount FROM messages GROUP BY 1, 2")
def a9_meter(spark, sf):
    return metrics.meter(logs.messages(spark, sf), ["subject"], "create_time", F.col("k"))


@query(LOGS + "SELECT subject, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.99) AS p99 FROM messages GROUP BY 1")
def a10_timer(spark, sf):
    return metrics.timer(logs.messages(spark, sf), ["subject"], "value", exact=True)


@query(LOGS + "SELECT subject, user_id, (max_by(value, create_time)) AS value FROM messages GROUP BY 1, 2")
def a11_gauge(spark, sf):
    return metrics.gauge(logs.messages(spark, sf), ["subject", "user_id"], "value", "create_time")


@query(LOGS + "SELECT subject, count(*) AS requests FROM messages WHERE date_trunc('minute', create_time) = (SELECT date_trunc('minute', create_time) FROM messages WHERE \"offset\" = 500) GROUP BY 1")
def a12_last_minute(spark, sf):
    """The minute before the one that follows a message of the log."""
    rows = logs.messages(spark, sf)
    now = rows.filter("offset = 500").select(F.col("create_time") + F.expr("INTERVAL 1 MINUTE")).scalar()
    return metrics.last_full_minute(rows, ["subject"], "create_time", now)


@query(LOGS + 'SELECT subject, "group", count(*) AS requests, CAST(sum(last_pull - first_pull + 1) AS BIGINT) AS messages FROM pulls GROUP BY 1, 2')
def a18_broker_counters(spark, sf):
    return logs.pulls(spark, sf).groupBy("subject", "group").agg(F.count("*").alias("requests"), F.sum(F.col("last_pull") - F.col("first_pull") + 1).alias("messages"))


@query(LOGS + """SELECT p.subject, p."group", greatest(m.low - p.last - 1, 0) AS expired FROM (SELECT subject, "group", max(last_msg) AS last FROM pulls WHERE block < 5 GROUP BY 1, 2) p
JOIN (SELECT subject, min(seq) AS low FROM messages WHERE create_time >= TIMESTAMP '2024-01-20' GROUP BY 1) m USING (subject)""")
def a19_expired(spark, sf):
    kept = logs.messages(spark, sf).filter("create_time >= timestamp_ntz '2024-01-20'")
    return progress.expired(progress.group_progress(logs.pulls(spark, sf).filter("block < 5")), progress.bounds(kept))


@query(LOGS + "SELECT max(\"offset\") - 500 AS behind FROM messages")
def a20_replay_lag(spark, sf):
    return logs.messages(spark, sf).agg((F.max("offset") - 500).alias("behind"))


@query(LOGS + 'SELECT subject, "group", count(*) AS n, CAST(max(epoch_us(d.pull_ts) - epoch_us(m.create_time)) AS BIGINT) AS longest FROM deliveries d JOIN messages m USING (subject, seq) GROUP BY 1, 2')
def a21_consumer_latency(spark, sf):
    rows = delivery.with_messages(delivery.deliveries(logs.pulls(spark, sf)), logs.messages(spark, sf), "create_time")
    late = F.unix_micros(F.col("pull_ts").cast("timestamp")) - F.unix_micros(F.col("create_time").cast("timestamp"))
    return rows.groupBy("subject", "group").agg(F.count("*").alias("n"), F.max(late).alias("longest"))


@query(LOGS + "SELECT * FROM deliveries")
def o2_pull_sequences(spark, sf):
    return delivery.deliveries(logs.pulls(spark, sf))


@query(LOGS + f"SELECT r.subject, r.\"group\", r.consumer_id, r.pull_seq, coalesce(d.seq, -1) AS seq FROM (SELECT * FROM (SELECT DISTINCT {_C} FROM pulls), (SELECT unnest([0, 5, 41, 1000000]) AS pull_seq)) r LEFT JOIN deliveries d USING ({_C}, pull_seq)")
def j1_pull_translation(spark, sf):
    places = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 5, 41, 1_000_000))))
    wanted = logs.pulls(spark, sf).select(*_CONSUMER).distinct().withColumn("pull_seq", places)
    found = delivery.translated(wanted, delivery.deliveries(logs.pulls(spark, sf)))
    return found.withColumn("pull_seq", F.col("pull_seq"))


@query(LOGS + "SELECT d.subject, d.\"group\", d.pull_seq, m.message_id, d.consumer_id FROM deliveries d JOIN messages m USING (subject, seq)")
def j3_payload_lookup(spark, sf):
    rows = delivery.with_messages(delivery.deliveries(logs.pulls(spark, sf)), logs.messages(spark, sf), "message_id")
    return rows.select(*_CONSUMER, "pull_seq", "message_id")


@query(_RECORDS + "SELECT * FROM records WHERE action = 1")
def j4_ack_records(spark, sf):
    found = delivery.ack_records(logs.acks(spark, sf), delivery.deliveries(logs.pulls(spark, sf)))
    return found.select("subject", "seq", "group", "consumer_id", "pull_seq", F.lit(1).cast("long").alias("action"), F.col("ack_ts").alias("at"))


@query(_RECORDS + "SELECT * FROM records JOIN (SELECT subject, seq FROM messages WHERE k = 42) USING (subject, seq)")
def j5_h5_trail(spark, sf):
    wanted = logs.messages(spark, sf).filter("k = 42")
    return history.trail(delivery.records(logs.pulls(spark, sf), logs.acks(spark, sf)), wanted)


@query(LOGS + "SELECT message_id, '%RETRY%' || subject || '%g0' AS subject, seq FROM messages WHERE k % 9 = 4 AND k < 60")
def j6_retry_trail(spark, sf):
    rows = logs.messages(spark, sf)
    again = rows.filter("k % 9 = 4").withColumn("subject", subjects.retry_subject(F.col("subject"), F.lit("g0")))
    log = rows.select("subject", "seq", "message_id").unionByName(again.select("subject", "seq", "message_id"))
    return history.retry_trail(log, log, rows.filter("k < 60").select("message_id").distinct()).select("message_id", "subject", "seq")


@query(_GAPS + "SELECT * FROM lost")
def p7_lost_acks(spark, sf):
    return delivery.lost_acks(logs.acks(spark, sf))


@query(LOGS + f"SELECT {_C}, CAST(count(*) AS BIGINT) AS duplicates FROM acks a JOIN deliveries d USING ({_C}) WHERE again = 1 AND pull_seq BETWEEN first_pull AND last_pull GROUP BY ALL")
def p7_duplicate_acks(spark, sf):
    return delivery.duplicate_acks(logs.acks(spark, sf))


@query(_GAPS + f"SELECT '%RETRY%' || subject || '%' || \"group\" AS subject, consumer_id, pull_seq, seq FROM lost JOIN deliveries USING ({_C}) WHERE pull_seq BETWEEN lo AND hi")
def p7_lost_to_retry(spark, sf):
    return delivery.sent_to_retry(logs.acks(spark, sf), delivery.deliveries(logs.pulls(spark, sf)))


@query(LOGS + f""", pending AS (
    SELECT d.*, pull_seq - row_number() OVER (PARTITION BY {_C} ORDER BY pull_seq) AS island, p.ack FROM deliveries d JOIN progress p USING ({_C}) JOIN messages m USING (subject, seq) WHERE pull_seq > p.ack - 50 AND k % 7 <> 0
), runs AS (SELECT {_C}, min(pull_seq) AS lo, max(pull_seq) AS hi, count(*) AS n, min(ack) - 50 AS ack FROM pending GROUP BY {_C}, island)
SELECT {_C}, lo, hi, n, lo - ack - 1 AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY lo) AS place FROM runs) WHERE place = 1""")
def p2_redelivery(spark, sf):
    done = progress.consumer_progress(logs.pulls(spark, sf), logs.acks(spark, sf)).withColumn("ack", F.col("ack") - 50)
    readable = logs.messages(spark, sf).filter("k % 7 <> 0").select("subject", "seq")
    return delivery.unacked_run(delivery.deliveries(logs.pulls(spark, sf)), done, readable)


@query(LOGS + """SELECT subject, start, CASE WHEN start < 0 OR start > high THEN high WHEN start < low THEN low ELSE start END AS "at",
CASE WHEN start < 0 THEN 'to end' WHEN start > high THEN 'overflow' WHEN start = high THEN 'nothing' WHEN start < low THEN 'too small' ELSE 'found' END AS status
FROM (SELECT subject, min(seq) AS low, max(seq) + 1 AS high FROM messages WHERE seq >= 10 GROUP BY 1), (SELECT unnest([-1, 0, 10, 15, 100000000]) AS start)""")
def p3_p4_read_rules(spark, sf):
    ends = logs.messages(spark, sf).filter("seq >= 10").groupBy("subject").agg(F.min("seq").alias("low"), (F.max("seq") + 1).alias("high"))
    rows = ends.withColumn("start", F.explode(F.array(*map(F.lit, (-1, 0, 10, 15, 100_000_000)))))
    at, status = progress.read_position(F.col("start"), F.col("low"), F.col("high"))
    return rows.select("subject", "start", at.alias("at"), status.alias("status"))


@query(LOGS + """SELECT s.subject, g AS "group", CASE WHEN g = 'new' THEN s.last ELSE p.last END + 1 AS start FROM (SELECT subject, max(seq) AS last FROM messages GROUP BY 1) s, (VALUES ('g0'), ('new')) x(g)
LEFT JOIN (SELECT subject, "group", max(last_msg) AS last FROM pulls WHERE block < 9 GROUP BY 1, 2) p ON p.subject = s.subject AND p."group" = g""")
def p5_group_start(spark, sf):
    ends = progress.bounds(logs.messages(spark, sf))
    groups = ends.select("subject", F.explode(F.array(F.lit("g0"), F.lit("new"))).alias("group"))
    return progress.start_of(groups, progress.group_progress(logs.pulls(spark, sf).filter("block < 9")), ends)


@query(LOGS + "SELECT subject, min(seq) AS earliest, max(seq) + 1 AS latest FROM messages GROUP BY 1")
def p6_offset_reset(spark, sf):
    ends = progress.bounds(logs.messages(spark, sf))
    return progress.reset(ends, "earliest").withColumnRenamed("start", "earliest").join(progress.reset(ends, "latest").withColumnRenamed("start", "latest"), "subject")


@query(LOGS + f""", done AS (SELECT {_C}, pull_seq, pull_seq - row_number() OVER (PARTITION BY {_C} ORDER BY pull_seq) AS island FROM deliveries WHERE seq % 17 <> 3),
runs AS (SELECT {_C}, min(pull_seq) AS lo, max(pull_seq) AS hi FROM done GROUP BY {_C}, island)
SELECT {_C}, lo + 6 * i AS first_pull, least(lo + 6 * i + 5, hi) AS last_pull FROM runs, (SELECT unnest(range(100000)) AS i) WHERE lo + 6 * i <= hi""")
def p8_ack_coalescing(spark, sf):
    return delivery.coalesced_acks(delivery.deliveries(logs.pulls(spark, sf)).filter("seq % 17 <> 3"), 6)


@query(LOGS + "SELECT message_id, CASE WHEN times + 1 > max_retry THEN '%DEAD_RETRY%' ELSE '%RETRY%' END || subject || '%g1' AS target, times + 1 AS times, times + 1 > max_retry AS dead FROM messages WHERE subject = 'error'")
def p9_retry_derivation(spark, sf):
    failed = logs.messages(spark, sf).filter("subject = 'error'").withColumn("group", F.lit("g1"))
    return retry.sent_back(failed, "2024-02-01 00:00:00").select("message_id", "target", "times", "dead")


@query(LOGS + "SELECT message_id, CASE WHEN max_retry < times + 1 THEN 'failed' WHEN k <= 50 THEN 'local' ELSE 'delayed' END AS action FROM messages")
def p10_delayed_retry(spark, sf):
    return logs.messages(spark, sf).select("message_id", retry.retry_action(F.col("k"), F.col("times"), F.col("max_retry")).alias("action"))


@query(LOGS + "SELECT message_id, CASE WHEN k % 3 = 0 THEN 32 WHEN k % 3 = 1 THEN 32 ELSE k END AS max_retry FROM messages")
def p11_default_retries(spark, sf):
    k = F.col("k")
    rows = logs.messages(spark, sf).select("message_id", F.when(k % 3 == 0, None).when(k % 3 == 1, -1).otherwise(k).alias("max_retry"))
    return retry.with_default_retries(rows)


@query(LOGS + "SELECT user_id, k % 4 AS part, min(\"offset\") AS \"offset\" FROM messages GROUP BY 1, 2")
def p15_idempotent_consumption(spark, sf):
    rows = logs.messages(spark, sf).select("user_id", (F.col("k") % 4).alias("part"), "offset")
    return delivery.first_seen(rows, ["user_id", "part"], ["offset"])


@query(LOGS + f"SELECT {_C}, count(*) AS left_over FROM deliveries JOIN progress USING ({_C}) WHERE pull_seq > ack - 50 GROUP BY ALL")
def p25_compaction(spark, sf):
    done = progress.consumer_progress(logs.pulls(spark, sf), logs.acks(spark, sf)).withColumn("ack", F.col("ack") - 50)
    return delivery.compacted(delivery.deliveries(logs.pulls(spark, sf)), done).groupBy(*_CONSUMER).agg(F.count("*").alias("left_over"))


@query(LOGS + f"SELECT {_C}, count(*) AS n FROM deliveries WHERE NOT (\"group\" = 'g1' AND consumer_id = 'c2') GROUP BY ALL")
def p33_forever_offline(spark, sf):
    gone = logs.pulls(spark, sf).filter("`group` = 'g1' AND consumer_id = 'c2'").select(*_CONSUMER).distinct()
    return delivery.without_gone(delivery.deliveries(logs.pulls(spark, sf)), gone).groupBy(*_CONSUMER).agg(F.count("*").alias("n"))


@query(LOGS + "SELECT subject, \"group\", unnest(['%RETRY%' || subject || '%' || \"group\", subject]) AS read FROM (SELECT DISTINCT subject, \"group\" FROM pulls)")
def u7_subjects_to_read(spark, sf):
    return retry.subjects_to_read(logs.pulls(spark, sf).select("subject", "group").distinct())


@query(LOGS + "SELECT subject, seq, message_id FROM messages WHERE subject = 'click' AND create_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15 12:00:00' ORDER BY create_time DESC, seq DESC LIMIT 50")
def h1_find_messages(spark, sf):
    found = history.find_messages(logs.messages(spark, sf), "click", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), _now(), 50)
    return found.select("subject", "seq", "message_id")


@query(LOGS + "SELECT message_id, '%DEAD_RETRY%' || subject || '%g' || (k % 2) AS subject FROM messages WHERE subject = 'error' AND times >= 3 ORDER BY create_time DESC, message_id DESC LIMIT 40")
def h2_find_dead(spark, sf):
    dead = logs.messages(spark, sf).filter("times >= 3").withColumn("subject", subjects.dead_subject(F.col("subject"), F.concat(F.lit("g"), F.col("k") % 2)))
    return history.find_dead(dead, "error", None, 40).select("message_id", "subject")


@query(LOGS + "SELECT m.message_id, m.value FROM messages m WHERE subject = 'error' AND times >= 3 AND k % 2 = 1")
def h3_dead_content(spark, sf):
    rows = logs.messages(spark, sf)
    dead = rows.filter("times >= 3").select(subjects.dead_subject(F.col("subject"), F.concat(F.lit("g"), F.col("k") % 2)).alias("dead"), "seq")
    mine = dead.filter(subjects.group_of(F.col("dead")) == "g1").select(subjects.real_subject(F.col("dead")).alias("subject"), "seq").filter("subject = 'error'")
    return logs.multi_get(rows, mine).select("message_id", "value")


@query(LOGS + "SELECT subject, seq, message_id, k, user_id FROM messages WHERE subject = 'view' AND seq = 3")
def h4_message_details(spark, sf):
    return logs.point(logs.messages(spark, sf), "view", 3).select("subject", "seq", "message_id", "k", "user_id")
