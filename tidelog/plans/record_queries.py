"""Action and pull logs, history rows, decoded values, trails and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import attrs, keys, subjects
from tidelog.operators import delay, delivery, filters, history, metrics, progress, retry, routing, sequence, store
from tidelog.plans.base import LOGS, query
from tidelog.plans.log_queries import _CODES
from tidelog.plans.progress_queries import _C, _CONSUMER, _RECORDS
from tidelog.sources import logs


@query(LOGS + 'SELECT "offset", message_id, CAST(sum(length(message_id)) OVER (ORDER BY "offset") AS BIGINT) AS visited FROM (SELECT * FROM messages WHERE "offset" >= greatest(-5, (SELECT min("offset") FROM messages)) ORDER BY "offset" LIMIT 40)')
def src2_log_cursor(spark, sf):
    return logs.cursor(logs.messages(spark, sf), -5, 40, F.length("message_id")).select("offset", "message_id", "visited")


@query(LOGS + 'SELECT subject, "group", consumer_id, kind, lo, hi, row_number() OVER (PARTITION BY subject, "group" ORDER BY "at") - 1 AS place FROM (SELECT subject, "group", consumer_id, \'pull\' AS kind, first_pull AS lo, last_pull AS hi, block * 4 AS "at" FROM pulls UNION ALL SELECT subject, "group", consumer_id, \'ack\', first_pull, last_pull, block * 4 + 1 + again FROM acks)')
def snk2_action_append(spark, sf):
    columns = [*_CONSUMER, "kind", F.col("first_pull").alias("lo"), F.col("last_pull").alias("hi"), "at"]
    pulled = logs.pulls(spark, sf).withColumns({"kind": F.lit("pull"), "at": F.col("block") * 4}).select(*columns)
    acked = logs.acks(spark, sf).withColumns({"kind": F.lit("ack"), "at": F.col("block") * 4 + 1 + F.col("again")}).select(*columns)
    return store.action_log(pulled.unionByName(acked), ["subject", "group"], "at").drop("at")


@query(LOGS + f"""SELECT {_C}, pull_seq, seq, CASE WHEN pull_seq <= (SELECT max(pull_seq) FROM deliveries e WHERE e.subject = d.subject AND e."group" = d."group" AND e.consumer_id = d.consumer_id AND pull_seq <= 60 AND pull_seq % 11 <> 4)
    THEN 'already written' ELSE 'written' END AS status FROM deliveries d WHERE pull_seq BETWEEN 40 AND 80""")
def snk4_pull_log_write(spark, sf):
    rows = delivery.deliveries(logs.pulls(spark, sf)).select(*_CONSUMER, "pull_seq", "seq")
    return store.put_in_pull_log(rows.filter("pull_seq <= 60 AND pull_seq % 11 <> 4"), rows.filter("pull_seq BETWEEN 40 AND 80"))


@query(LOGS + f"""SELECT {_C}, pull_seq, CASE WHEN pull_seq % 11 = 4 THEN -1 ELSE seq END AS seq FROM deliveries d
WHERE pull_seq <= (SELECT max(pull_seq) FROM deliveries e WHERE e.subject = d.subject AND e."group" = d."group" AND e.consumer_id = d.consumer_id AND pull_seq % 11 <> 4)""")
def snk4_pull_log_holes(spark, sf):
    return store.with_holes(delivery.deliveries(logs.pulls(spark, sf)).filter("pull_seq % 11 <> 4"))


@query(_CODES + """, retried AS (SELECT *, false AS again FROM dated UNION ALL SELECT *, true FROM dated WHERE k % 9 = 4)
SELECT CASE WHEN again THEN code || md5(message_id) || inverted || '000007' || '000001' || lpad(CAST(seq AS VARCHAR), 19, '0') ELSE code || inverted || md5(message_id) END AS row_key,
    seq || '|' || epoch_us(create_time) || '|b1|' || message_id AS value FROM retried""")
def snk11_index_history(spark, sf):
    rows = logs.messages(spark, sf).select("subject", "seq", "create_time", "message_id", "k")
    again = rows.filter("k % 9 = 4").withColumn("subject", subjects.retry_subject(F.col("subject"), F.lit("g0")))
    return store.index_rows(rows.unionByName(again), keys.dictionary(rows, "subject"), "000007", keys.dictionary(logs.pulls(spark, sf), "group"))


def _dead(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that failed too often, under the dead subject of either group; every fifth has no body left."""
    k = F.col("k")
    rows = logs.messages(spark, sf).filter("times >= 3")
    return rows.select(subjects.dead_subject(F.col("subject"), F.concat(F.lit("g"), k % 2)).alias("subject"), "seq", "create_time", "message_id", F.when(k % 5 > 0, F.concat(F.lit("v"), k)).alias("body"))


_DEAD = _CODES + """, dead AS (SELECT *, 'g' || (k % 2) AS grp, lpad(CAST(k % 2 + 1 AS VARCHAR), 6, '0') AS grp_code, CASE WHEN k % 5 > 0 THEN 'v' || k END AS body FROM dated WHERE times >= 3)
"""


@query(_DEAD + """SELECT 'message' AS kind, code || grp_code || inverted || md5(message_id) AS row_key, seq || '|' || epoch_us(create_time) || '|b1|' || message_id AS value FROM dead
UNION ALL SELECT 'record', code || md5(message_id) || grp_code, seq || '|' || (epoch_us(create_time) // 1000 + 500) || '|' || grp FROM dead
UNION ALL SELECT 'content', code || grp_code || inverted || md5(message_id), body FROM dead WHERE body IS NOT NULL""")
def snk13_dead_rows(spark, sf):
    return store.dead_rows(_dead(spark, sf), keys.dictionary(logs.messages(spark, sf), "subject"), keys.dictionary(logs.pulls(spark, sf), "group"))


@query(LOGS + """, counts AS (SELECT subject, "group", count(*) AS requests, CAST(sum(last_pull - first_pull + 1) AS BIGINT) AS messages, max(last_msg) AS last FROM pulls GROUP BY 1, 2)
SELECT name, labels, CAST(value AS DOUBLE) AS value FROM (SELECT 'group=' || "group" || ',subject=' || subject AS labels, unnest([{'name': 'pull_requests_total', 'value': requests}, {'name': 'pulled_messages_total', 'value': messages}, {'name': 'last_pulled', 'value': last}], recursive := true) FROM counts)""")
def snk17_metrics_export(spark, sf):
    pulls = logs.pulls(spark, sf)
    counts = pulls.groupBy("subject", "group").agg(F.count("*").alias("pull_requests_total"), F.sum(F.col("last_pull") - F.col("first_pull") + 1).alias("pulled_messages_total"), F.max("last_msg").alias("last_pulled"))
    return metrics.exported(counts, ["group", "subject"], ["pull_requests_total", "pulled_messages_total", "last_pulled"])


@query("""SELECT name, lpad(CAST(place AS VARCHAR), 6, '0') AS code FROM (SELECT name, row_number() OVER (ORDER BY name NOT IN ('BUILDING', 'MACHINERY'), name) AS place FROM (SELECT DISTINCT c_mktsegment AS name FROM customer))""")
def k8_dictionary_grows(spark, sf):
    """New names get the codes after those of the dictionary; known ones keep theirs."""
    rows = logs.read(spark, sf, "customer")
    known = keys.dictionary(rows.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')"), "c_mktsegment")
    return keys.dictionary(rows, "c_mktsegment", known)


@query(LOGS + """SELECT message_id, CASE WHEN k % 2 = 0 THEN 4 ELSE 0 END AS flag, create_time, create_time + INTERVAL 1 HOUR AS schedule_time, subject, CASE WHEN k % 2 = 0 THEN array_to_string(tags, ',') END AS tags,
    CASE WHEN k % 13 = 0 THEN 'true' END AS corrupt, CASE WHEN k % 13 <> 0 THEN CAST(user_id AS VARCHAR) END AS user FROM messages""")
def k10_message_decode(spark, sf):
    k = F.col("k")
    sent = F.when(k % 13 == 0, F.lit("{broken")).otherwise(F.to_json(F.create_map(F.lit("user"), F.col("user_id").cast("string"))))
    value = store.packed_message(F.when(k % 2 == 0, attrs.TAGGED).otherwise(0), F.col("create_time"), F.col("create_time") + F.expr("INTERVAL 1 HOUR"), F.col("subject"), F.col("message_id"), F.col("tags"), sent)
    rows = logs.messages(spark, sf).select(value.alias("v"))
    found = rows.select(*(c.alias(n) for n, c in store.unpacked_message(F.col("v")).items()))
    a = F.col("attrs")
    return found.select("message_id", "flag", "create_time", "schedule_time", "subject", F.array_join("tags", ",").alias("tags"), attrs.text(a, attrs.CORRUPT).alias("corrupt"), attrs.text(a, "user").alias("user"))


@query(_RECORDS + "SELECT seq, CAST(action AS VARCHAR) AS action, consumer_id, pull_seq, \"at\" FROM records")
def k11_record_decode(spark, sf):
    """Records under their keys, and what is read back: sequence and action from the key, the rest from the value."""
    pulls = logs.pulls(spark, sf)
    rows = store.record_rows(delivery.records(pulls, logs.acks(spark, sf)), keys.dictionary(pulls, "subject"), "000007", keys.dictionary(pulls, "group"))
    stored = rows.select("row_key", F.concat_ws("|", "pull_seq", F.unix_micros(F.col("at").cast("timestamp")), "consumer_id").alias("value"))
    part = F.split("value", r"\|", 3)
    return stored.select(*(c.alias(n) for n, c in keys.record_fields(F.col("row_key")).items()), part[2].alias("consumer_id"), part[0].cast("long").alias("pull_seq"), F.timestamp_micros(part[1].cast("long")).cast("timestamp_ntz").alias("at"))


@query(LOGS + "SELECT message_id, make_timestamp_ms(epoch_us(create_time) // 1000) AS sent, CASE WHEN k % 4 = 0 THEN NULL ELSE make_timestamp_ms(epoch_us(create_time) // 1000) END AS due FROM messages")
def map2_time_getter(spark, sf):
    stamp = F.unix_millis(F.col("create_time").cast("timestamp"))
    rows = logs.messages(spark, sf).select("message_id", attrs.as_attributes({"sent": stamp, "due": F.when(F.col("k") % 4 != 0, stamp)}).alias("a"))
    return rows.select("message_id", attrs.moment(F.col("a"), "sent").alias("sent"), attrs.moment(F.col("a"), "due").alias("due"))


@query(LOGS + "SELECT message_id, subject, seq FROM messages m WHERE seq < coalesce((SELECT min(seq) FROM messages b WHERE b.subject = m.subject AND b.create_time + INTERVAL 5 SECOND > TIMESTAMP '2024-01-12 06:00:00'), 9999999999)")
def f5_retry_gate(spark, sf):
    ready = filters.retry_ready(F.col("create_time"), F.lit("2024-01-12 06:00:00").cast("timestamp_ntz"))
    return filters.ready_prefix(logs.messages(spark, sf), ["subject"], "seq", ready).select("message_id", "subject", "seq")


@query(LOGS + """SELECT message_id, k % 7 <> 0 AND k % 5 <> 0 AS handled, CASE WHEN k % 7 = 0 THEN 'pre trace,post trace' WHEN k % 5 = 0 THEN 'pre trace,pre once,post once,post trace' ELSE 'pre trace,pre once,pre own,post own,post once,post trace' END AS ran FROM messages""")
def f7_hooks(spark, sf):
    k = F.col("k")
    found = filters.hooked(logs.messages(spark, sf), [("trace", k % 7 != 0), ("once", k % 5 != 0), ("own", F.lit(True))])
    return found.select("message_id", "handled", F.array_join("ran", ",").alias("ran"))


_PATTERN_SQL = _CODES + """, k1 AS (SELECT code || inverted || md5(message_id) AS row_key FROM dated), retry AS (SELECT code || md5(message_id) || inverted || '000007' || '000002' || lpad(CAST(seq AS VARCHAR), 19, '0') AS row_key FROM dated),
dead AS (SELECT code || lpad(CAST(k % 2 + 1 AS VARCHAR), 6, '0') || inverted || md5(message_id) AS row_key FROM dated), dead_record AS (SELECT code || md5(message_id) || '000002' AS row_key FROM dated),
record AS (SELECT code || lpad(CAST(seq AS VARCHAR), 19, '0') || '000007' || '000002' || (k % 2) AS row_key FROM dated)
SELECT name, row_key FROM (
    SELECT 'subject' AS name, row_key FROM k1 WHERE regexp_matches(row_key, '^000002[ \\d]{12}\\w{32}$') UNION ALL SELECT 'message', row_key FROM k1 WHERE row_key LIKE '000002%' || md5('m7')
    UNION ALL SELECT 'retry', row_key FROM retry WHERE row_key LIKE '______' || md5('m7') || '%' AND row_key LIKE '000002%'
    UNION ALL SELECT 'dead', row_key FROM dead WHERE row_key LIKE '000002%' UNION ALL SELECT 'dead of group', row_key FROM dead WHERE row_key LIKE '000002000001%'
    UNION ALL SELECT 'dead record', row_key FROM dead_record WHERE row_key LIKE '000002' || md5('m7') || '%' UNION ALL SELECT 'record', row_key FROM record WHERE row_key LIKE '0000020000000000000000003000007%'
)"""


@query(_PATTERN_SQL)
def f13_key_patterns(spark, sf):
    """Row keys of every history table that the table's patterns find, for one subject and partly for one message."""
    rows = logs.messages(spark, sf)
    rows = keys.encoded(rows, keys.dictionary(rows, "subject"), "subject", "code")
    code, time, m, k = F.col("code"), F.col("create_time"), F.col("message_id"), F.col("k")
    group = F.lpad((k % 2 + 1).cast("string"), 6, "0")
    tables = {
        "k1": keys.message_key(code, time, m),
        "retry": keys.retry_message_key(code, time, m, F.lit("000007"), F.lit("000002"), F.col("seq")),
        "dead": keys.dead_message_key(code, group, time, m),
        "dead_record": keys.dead_record_key(code, m, F.lit("000002")),
        "record": keys.record_key(code, F.col("seq"), F.lit("000007"), F.lit("000002"), (k % 2).cast("string")),
    }
    import hashlib

    one = hashlib.md5(b"m7").hexdigest()
    wanted = [
        ("subject", "k1", keys.message_pattern("000002")),
        ("message", "k1", keys.message_pattern("000002", one)),
        ("retry", "retry", keys.retry_message_pattern("000002", one)),
        ("dead", "dead", keys.dead_message_pattern("000002")),
        ("dead of group", "dead", keys.dead_message_pattern("000002", "000001")),
        ("dead record", "dead_record", keys.dead_record_pattern("000002", one)),
        ("record", "record", keys.record_pattern("000002", 3, "000007")),
    ]
    found = [F.when(F.rlike(tables[table], F.lit(pattern)), F.struct(F.lit(name).alias("name"), tables[table].alias("row_key"))) for name, table, pattern in wanted]
    return rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.*")


def _retried(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The index of retry messages, where some stand twice, and the pulls and acks of all of them."""
    rows = logs.messages(spark, sf).filter("k % 9 = 4")
    metas = rows.select(subjects.retry_subject(F.col("subject"), F.lit("g0")).alias("subject"), "seq", "message_id", "create_time", "k")
    twice = metas.unionByName(metas.filter("k % 2 = 0"))
    pull, ack = F.lit(0).cast("long"), F.lit(1).cast("long")
    done = F.when(F.col("k") % 4 == 1, F.array(pull)).otherwise(F.array(pull, ack))
    return twice.drop("k"), metas.select("subject", "seq", F.explode(done).alias("action"))


_RETRIED = LOGS + """, metas AS (SELECT DISTINCT message_id, '%RETRY%' || subject || '%g0' AS subject, seq, k FROM messages WHERE k % 9 = 4 AND create_time > TIMESTAMP '2024-02-10' - INTERVAL 30 DAY AND create_time <= TIMESTAMP '2024-02-10')
"""


@query(_RETRIED + "SELECT message_id, subject, seq FROM metas")
def u6_retry_metas(spark, sf):
    return history.retry_metas(_retried(spark, sf)[0], F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).select("message_id", "subject", "seq")


@query(_RETRIED + "SELECT message_id, subject, seq, CAST(action AS BIGINT) AS action FROM metas, (VALUES (0), (1)) x(action) WHERE action = 0 OR k % 4 <> 1")
def j6_retry_records(spark, sf):
    """The pull and ack rows of retry messages of the last thirty days; unacked ones have a pull alone."""
    index, records = _retried(spark, sf)
    metas = history.retry_metas(index, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))
    return metas.join(records, ["subject", "seq"]).select("message_id", "subject", "seq", "action")


@query(_DEAD + "SELECT message_id, seq, make_timestamp_ms(epoch_us(create_time) // 1000 + 500) AS \"at\", grp AS \"group\" FROM dead WHERE subject = 'error' AND message_id LIKE 'm1%'")
def j7_dead_trail(spark, sf):
    """The dead records of given messages of a subject, by their keys, a hundred of each at most."""
    rows = store.dead_rows(_dead(spark, sf), codes := keys.dictionary(logs.messages(spark, sf), "subject"), keys.dictionary(logs.pulls(spark, sf), "group"))
    wanted = logs.messages(spark, sf).filter(F.startswith("message_id", F.lit("m1"))).select(F.lit("error").alias("subject"), "message_id")
    return history.dead_trail(rows.filter("kind = 'record'"), keys.encoded(wanted, codes, "subject", "code"), 100)


@query(LOGS + """, seen AS (SELECT subject, create_time, "offset", "offset" - k % 3 AS copied FROM messages), lag AS (SELECT subject, max(create_time) FILTER (copied >= "offset") AS caught_up, max(create_time) AS last FROM seen GROUP BY 1)
SELECT subject, caught_up, caught_up IS NULL OR last - caught_up > INTERVAL 5 SECOND AS read_only FROM lag""")
def a17_slave_positions(spark, sf):
    """A group is read-only while its slave, by the positions both have reported, has not caught up for five seconds."""
    seen = logs.messages(spark, sf).select("subject", "create_time", "offset", (F.col("offset") - F.col("k") % 3).alias("copied"))
    return routing.slave_lag(seen, ["subject"], "create_time", "offset", "copied")


@query(LOGS + """SELECT subject, "group", name, CAST(value AS BIGINT) AS value FROM (
    SELECT subject, "group", 'pull requests' AS name, count(*) AS value FROM pulls GROUP BY 1, 2 UNION ALL SELECT subject, "group", 'pulled messages', sum(last_pull - first_pull + 1) FROM pulls GROUP BY 1, 2
    UNION ALL SELECT subject, "group", 'ack requests', count(*) FROM acks GROUP BY 1, 2 UNION ALL SELECT subject, "group", 'acked messages', sum(last_pull - first_pull + 1) FROM acks GROUP BY 1, 2
    UNION ALL SELECT subject, "group", 'duplicate acks', sum(last_pull - first_pull + 1) FROM acks WHERE again = 1 GROUP BY 1, 2
    UNION ALL SELECT subject, "group", 'short pulls', count(*) FROM pulls WHERE last_pull - first_pull < 19 GROUP BY 1, 2)""")
def a18_every_counter(spark, sf):
    return metrics.broker_counters(logs.pulls(spark, sf), logs.acks(spark, sf), 20)


@query(LOGS + """SELECT "group", (SELECT max("offset") FROM messages) - max(m."offset") AS behind FROM pulls p JOIN messages m ON m.subject = p.subject AND m.seq = p.last_msg WHERE block < 9 GROUP BY 1""")
def a20_replayers(spark, sf):
    """How far each group's replay of the log is behind its end."""
    rows = logs.messages(spark, sf)
    done = logs.pulls(spark, sf).filter("block < 9").select("subject", "group", F.col("last_msg").alias("seq")).join(rows.select("subject", "seq", "offset"), ["subject", "seq"])
    return progress.replay_lag(rows, done.groupBy("group").agg(F.max("offset").alias("iterated")))


@query(LOGS + """SELECT subject, "group", count(*) AS n, CAST(max(epoch_us(d.pull_ts) // 1000 - epoch_us(m.create_time) // 1000) AS BIGINT) AS longest_delay, CAST(sum(k) AS BIGINT) AS handled_ms, max(k) AS longest_ms, CAST(count(*) FILTER (k % 11 = 0) AS BIGINT) AS failures
FROM deliveries d JOIN messages m USING (subject, seq) GROUP BY 1, 2""")
def a21_consumer_metrics(spark, sf):
    rows = delivery.with_messages(delivery.deliveries(logs.pulls(spark, sf)), logs.messages(spark, sf), "create_time", "k")
    return metrics.consumption(rows, ["subject", "group"], "create_time", "pull_ts", F.col("k"), F.col("k") % 11 == 0)


@query(LOGS + f"""SELECT {_C}, block, first_msg, last_msg, CASE WHEN "group" = 'g1' THEN first_msg ELSE CAST(sum(last_msg - first_msg + 1) OVER w AS BIGINT) - (last_msg - first_msg + 1) END AS first_pull,
    CASE WHEN "group" = 'g1' THEN last_msg ELSE CAST(sum(last_msg - first_msg + 1) OVER w AS BIGINT) - 1 END AS last_pull FROM pulls WINDOW w AS (PARTITION BY {_C} ORDER BY block)""")
def o2_assigned_pulls(spark, sf):
    """Pull places as they are dealt: consumers of g0 count on, those of g1 are broadcast to and keep the messages' places."""
    taken = logs.pulls(spark, sf).select(*_CONSUMER, "block", "first_msg", "last_msg")
    return delivery.assigned(taken, "block", F.col("group") == "g1")


@query(LOGS + """, kept AS (SELECT subject, seq, seq - row_number() OVER (PARTITION BY subject ORDER BY seq) AS island FROM messages WHERE list_has_any(tags, ['k1', 'p2']) AND seq < 400),
parts AS (SELECT subject, min(seq) AS lo, max(seq) AS hi, count(*) AS n FROM kept GROUP BY subject, island)
SELECT subject, lo, hi, row_number() OVER (PARTITION BY subject ORDER BY lo) - 1 AS part, CAST(sum(n) OVER (PARTITION BY subject ORDER BY lo) AS BIGINT) AS upto, min(lo) OVER (PARTITION BY subject) AS start FROM parts""")
def u3_merged_results(spark, sf):
    """The kept ranges of one read as one result: in order, with the messages up to each and where the whole begins."""
    kept = filters.kept_ranges(logs.messages(spark, sf).filter("seq < 400"), [filters.tag_filter("OR", ["k1", "p2"], F.col("tags"))], ["subject"]).filter("n > 0")
    return sequence.as_one_result(kept, ["subject"], "lo", "n").select("subject", "lo", "hi", "part", "upto", "start")


_SILENT = LOGS + f""", silent AS (SELECT {_C}, max(ts) AS last_seen FROM pulls GROUP BY ALL), judged AS (SELECT s.*, p.ack - CASE WHEN consumer_id = 'c1' THEN 0 ELSE 30 END AS ack, p.pull, CASE WHEN TIMESTAMP '2024-01-31 00:20:00' - last_seen >= INTERVAL 30 MINUTE THEN 'forever' WHEN TIMESTAMP '2024-01-31 00:20:00' - last_seen >= INTERVAL 3 MINUTE THEN 'offline' ELSE 'online' END AS status
FROM silent s JOIN progress p USING ({_C}))
"""


def _silent(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pulls = logs.pulls(spark, sf)
    status = routing.liveness(pulls.select(*_CONSUMER, "ts"), _CONSUMER, F.lit("2024-01-31 00:20:00").cast("timestamp_ntz"), gone=30)
    done = progress.consumer_progress(pulls, logs.acks(spark, sf)).withColumn("ack", F.col("ack") - F.when(F.col("consumer_id") == "c1", 0).otherwise(30))
    return status, done


@query(_SILENT + f"SELECT '%RETRY%' || subject || '%' || \"group\" AS subject, consumer_id, d.pull_seq, d.seq FROM judged JOIN deliveries d USING ({_C}) WHERE status <> 'online' AND pull_seq > ack")
def p12_silent_to_retry(spark, sf):
    """What silent consumers have pulled and not acked goes to the retry subject of their group."""
    status, done = _silent(spark, sf)
    return retry.of_silent(delivery.deliveries(logs.pulls(spark, sf)), done, status)


@query(_SILENT + f"SELECT {_C}, status, CASE WHEN status = 'forever' AND ack >= pull THEN 'unsubscribe' WHEN status = 'online' THEN 'none' ELSE 'retry' END AS action FROM judged")
def p12_silent_actions(spark, sf):
    status, done = _silent(spark, sf)
    return retry.silent_actions(done, status)


@query(LOGS + 'SELECT user_id, k % 4 AS part, min("offset" // 1000) AS batch FROM messages GROUP BY 1, 2')
def p16_processed_once(spark, sf):
    """Which batch of a sink that keeps its keys with its rows handles each key; later ones find it there."""
    rows = logs.messages(spark, sf).select("user_id", (F.col("k") % 4).alias("part"), F.floor(F.col("offset") / 1000).alias("batch"))
    return delivery.first_seen(rows, ["user_id", "part"], ["batch"])


@query()
def p29_circuit_breaker(spark, sf):
    """Changes of a breaker for each broker: five failures in a row open it for an hour, then three successes close it."""
    calls = logs.messages(spark, sf).select("subject", F.col("create_time").alias("ts"), "offset", (F.col("k") % 4 == 0).alias("ok"))
    return retry.breaker_changes(calls, "subject", "ts", "offset", failures=5, open_ms=3_600_000, successes=3)


@query(LOGS + """, last AS (SELECT user_id, k % 3 AS source, arg_max(k % 2 = 0, "offset") AS is_on FROM messages GROUP BY 1, 2)
SELECT user_id, CAST(coalesce(sum(CASE WHEN is_on THEN 1 << source ELSE 0 END), 0) AS BIGINT) AS state, coalesce(sum(CASE WHEN is_on THEN 1 << source ELSE 0 END), 0) = 7 AS switched_on FROM last GROUP BY 1""")
def p31_three_switches(spark, sf):
    """A client is on while health check, operators and its own code all have it on; each one's last word counts."""
    k = F.col("k")
    words = logs.messages(spark, sf).select("user_id", F.element_at(F.array(F.lit("health"), F.lit("ops"), F.lit("code")), (k % 3 + 1).cast("int")).alias("source"), (k % 2 == 0).alias("on"), "offset")
    return routing.switches(words, ["user_id"], "source", "on", "offset")


@query(LOGS + "SELECT message_id, CASE WHEN k % 12 < 8 THEN 1 ELSE 5 END AS flag, CASE WHEN k % 12 < 8 THEN NULL ELSE array_to_string(tags, ',') END AS tags FROM messages")
def p34_by_protocol(spark, sf):
    """Clients of a protocol before 8 get messages without tags and without the flag that announces them."""
    rows = logs.messages(spark, sf).select("message_id", F.lit(attrs.TAGGED | attrs.NOT_RELIABLE).alias("flag"), "tags", (F.col("k") % 12).alias("version"))
    return filters.for_protocol(rows, "version").select("message_id", "flag", F.array_join("tags", ",").alias("tags"))


@query(LOGS + """SELECT g.group_name, g.kind, broker_state, coalesce(string_agg(r.subject, ' ' ORDER BY r.subject), '') AS subjects FROM broker_groups g LEFT JOIN (SELECT subject, group_name FROM routed) r USING (group_name) GROUP BY 1, 2, 3""")
def h6_group_list(spark, sf):
    groups = logs.broker_groups(spark, sf)
    named = routing.routed(logs.routes(spark, sf), groups).select("subject", "group_name")
    return routing.group_list(groups, named).select("group_name", "kind", "broker_state", F.array_join("subjects", " ").alias("subjects"))


@query(LOGS + """SELECT subject, string_agg(group_name, ' ' ORDER BY group_name) AS route FROM routed GROUP BY 1""")
def h6_route_list(spark, sf):
    named = routing.routed(logs.routes(spark, sf), logs.broker_groups(spark, sf))
    return named.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("group_name")), " ").alias("route"))


@query(LOGS + "SELECT bucket, seq, (row_number() OVER (PARTITION BY bucket ORDER BY seq) - 1) * 8 AS position FROM dispatched")
def src7_dispatch_positions(spark, sf):
    """A bucket's dispatch log is one number for each message; where each begins."""
    rows = sequence.with_sequence(delay.bucketed(logs.dispatched(spark, sf)).select("bucket", "seq"), ["bucket"], "seq", "_place")
    return rows.select("bucket", "seq", (F.col("_place") * 8).alias("position"))


@query(LOGS + "SELECT group_name, g.kind, g.tag, g.broker_state, count(r.subject) AS routes FROM broker_groups g LEFT JOIN (SELECT subject, group_name FROM routed) r USING (group_name) GROUP BY 1, 2, 3, 4")
def src15_groups_with_routes(spark, sf):
    groups = logs.broker_groups(spark, sf)
    used = routing.routed(logs.routes(spark, sf), groups).groupBy("group_name").agg(F.count("*").alias("routes"))
    return groups.join(used, "group_name", "left").select("group_name", "kind", "tag", "broker_state", F.coalesce("routes", F.lit(0)).alias("routes"))


_JSON = """'{"i":' || k || ',"l":' || (event_id + 3000000000) || ',"d":' || k || '.5,"b":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"s":"x' || k || '","n":null,"o":{"a":' || k || '}}'"""


@query(f"""SELECT event_id, key, CASE json_type(j, '$.' || key) WHEN 'UBIGINT' THEN CASE WHEN key = 'l' THEN 'long' ELSE 'integer' END WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'other' END AS kind,
    json_extract_string(j, '$.' || key) AS text FROM (SELECT event_id, j, unnest(json_keys(j)) AS key FROM (SELECT event_id, CAST({_JSON} AS JSON) AS j FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))""")
def src16_typed_properties(spark, sf):
    rows = logs.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return logs.typed_properties(rows.select("event_id", F.expr(_JSON).alias("j")), "j").select("event_id", "key", "kind", "text")
