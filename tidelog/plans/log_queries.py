"""Scans, appends, keys, filters and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import attrs, keys, subjects
from tidelog.operators import filters, sequence
from tidelog.plans.base import LOGS, query
from tidelog.sources import logs

_MSG = ["subject", "seq", "message_id"]

def _now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


@query(LOGS + 'SELECT subject, seq, message_id, "offset" FROM messages WHERE "offset" >= 300')
def src1_log_scan(spark, sf):
    return logs.scan_from(logs.messages(spark, sf), 300).select(*_MSG, "offset")


@query(LOGS + "SELECT subject, \"group\", consumer_id, first_pull, last_pull FROM pulls WHERE ts >= TIMESTAMP '2024-01-10'")
def src3_action_scan(spark, sf):
    return logs.pulls(spark, sf).filter("ts >= timestamp_ntz '2024-01-10'").select("subject", "group", "consumer_id", "first_pull", "last_pull")


@query(LOGS + "SELECT subject, seq, message_id, create_time FROM messages WHERE k % 10 <> 0 AND subject <> 'view'")
def src4_index_scan(spark, sf):
    rows = logs.messages(spark, sf)
    broken = rows.withColumn("seq", F.when(F.col("k") % 10 == 0, -1).otherwise(F.col("seq"))).withColumn("subject", F.when(F.col("subject") == "view", "").otherwise(F.col("subject")))
    return logs.valid_index(broken).select(*_MSG, "create_time")


@query(LOGS + "SELECT seq, subject, schedule_time FROM delayed")
def src6_schedule_index(spark, sf):
    return logs.delayed(spark, sf).select("seq", "subject", "schedule_time")


@query(LOGS + "SELECT seq FROM dispatched")
def src7_dispatch_scan(spark, sf):
    return logs.dispatched(spark, sf).select("seq")


@query(LOGS + "SELECT subject, seq, message_id, value FROM messages WHERE subject = 'click' AND seq = 7")
def src9_point_lookup(spark, sf):
    return logs.point(logs.messages(spark, sf), "click", 7).select(*_MSG, "value")


@query(LOGS + 'SELECT subject, seq, message_id FROM messages WHERE "offset" >= 100 AND "offset" < 250')
def src11_offset_range(spark, sf):
    return logs.scan_between(logs.messages(spark, sf), 100, 250).select(*_MSG)


@query(LOGS + "SELECT subject, seq, message_id FROM messages WHERE subject IN ('click', 'error') AND seq IN (0, 3, 17, 18)")
def src14_multi_get(spark, sf):
    wanted = [(s, q) for s in ("click", "error", "absent") for q in (0, 3, 17, 18, 10**9)]
    return logs.multi_get(logs.messages(spark, sf), spark.createDataFrame(wanted, "subject string, seq long")).select(*_MSG)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def src16_json_receive(spark, sf):
    rows = logs.received_json(logs.read(spark, sf, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.col("attrs")["k"].alias("k"))


@query(LOGS + "SELECT subject, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total, max(seq) AS last FROM messages GROUP BY subject")
def snk1_append_sequence(spark, sf):
    return logs.messages(spark, sf).groupBy("subject").agg(F.count("*").alias("n"), F.sum("seq").alias("total"), F.max("seq").alias("last"))


@query(LOGS + "SELECT subject, seq, message_id FROM messages")
def snk3_idempotent_write(spark, sf):
    from tidelog.operators.delivery import first_seen

    rows = logs.messages(spark, sf).select(*_MSG, F.lit(0).alias("copy"))
    again = rows.filter("seq % 3 = 0").withColumn("copy", F.lit(1))
    return first_seen(rows.unionByName(again), ["subject", "seq"], ["copy"]).drop("copy")


@query(LOGS + "SELECT bucket, count(*) AS n, min(seq) AS low FROM delayed GROUP BY bucket")
def snk7_bucket_append(spark, sf):
    from tidelog.operators.delay import bucketed

    return bucketed(logs.delayed(spark, sf)).groupBy("bucket").agg(F.count("*").alias("n"), F.min("seq").alias("low"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders")
def snk9_global_sequence(spark, sf):
    return sequence.with_sequence(logs.read(spark, sf, "orders").select("o_orderkey"), [], "o_orderkey", first=1, segment=4096)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN -100 ELSE 0 END AS state FROM orders WHERE o_orderkey % 5 <> 0")
def snk16_outbox_state(spark, sf):
    """All orders are put into the outbox; every fifth has been sent, and some others are blocked."""
    from tidelog.operators.store import outbox

    rows = logs.read(spark, sf, "orders").select("o_orderkey")
    return outbox(rows, rows.filter("o_orderkey % 5 = 0"), rows.filter("o_orderkey % 7 = 3"), "o_orderkey").withColumnRenamed("status", "state")


_CODES = LOGS + """, codes AS (SELECT subject, lpad(CAST(row_number() OVER (ORDER BY subject) AS VARCHAR), 6, '0') AS code FROM (SELECT DISTINCT subject FROM messages)),
dated AS (SELECT *, lpad(CAST(999999999999 - CAST(strftime(create_time, '%y%m%d%H%M%S') AS BIGINT) AS VARCHAR), 12, ' ') AS inverted FROM messages JOIN codes USING (subject))
"""


def _coded(spark, sf):
    rows = logs.messages(spark, sf)
    return keys.encoded(rows, keys.dictionary(rows, "subject"), "subject", "code")


@query(_CODES + "SELECT message_id, code || inverted || md5(message_id) AS row_key FROM dated")
def k1_message_key(spark, sf):
    return _coded(spark, sf).select("message_id", keys.message_key(F.col("code"), F.col("create_time"), F.col("message_id")).alias("row_key"))


@query(_CODES + "SELECT message_id, code || md5(message_id) || inverted || '000007' || '000002' || lpad(CAST(seq AS VARCHAR), 19, '0') AS row_key FROM dated")
def k1_retry_message_key(spark, sf):
    key = keys.retry_message_key(F.col("code"), F.col("create_time"), F.col("message_id"), F.lit("000007"), F.lit("000002"), F.col("seq"))
    return _coded(spark, sf).select("message_id", key.alias("row_key"))


@query(_CODES + "SELECT message_id, code || '000002' || inverted || md5(message_id) AS row_key FROM dated")
def k2_dead_message_key(spark, sf):
    return _coded(spark, sf).select("message_id", keys.dead_message_key(F.col("code"), F.lit("000002"), F.col("create_time"), F.col("message_id")).alias("row_key"))


@query(_CODES + "SELECT message_id, code || md5(message_id) || '000002' AS row_key FROM dated")
def k3_dead_record_key(spark, sf):
    return _coded(spark, sf).select("message_id", keys.dead_record_key(F.col("code"), F.col("message_id"), F.lit("000002")).alias("row_key"))


@query(_CODES + "SELECT message_id, code || lpad(CAST(seq AS VARCHAR), 19, '0') || '000007' || '000002' || CAST(k % 2 AS VARCHAR) AS row_key, seq, CAST(k % 2 AS VARCHAR) AS action FROM dated")
def k4_record_key(spark, sf):
    key = keys.record_key(F.col("code"), F.col("seq"), F.lit("000007"), F.lit("000002"), (F.col("k") % 2).cast("string"))
    rows = _coded(spark, sf).select("message_id", key.alias("row_key"))
    return rows.withColumns(keys.record_fields(F.col("row_key")))


@query(_CODES + "SELECT message_id, inverted, md5(message_id) AS digest, substr(md5(message_id), 9, 16) AS short, lpad(CAST(seq AS VARCHAR), 19, '0') AS place FROM dated")
def k5_k7_key_parts(spark, sf):
    m = F.col("message_id")
    return logs.messages(spark, sf).select("message_id", keys.inverted_date(F.col("create_time")).alias("inverted"), keys.digest(m).alias("digest"), keys.short_digest(m).alias("short"), keys.padded(F.col("seq")).alias("place"))


@query("SELECT name, lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 6, '0') AS code FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)")
def k8_dictionary(spark, sf):
    return keys.dictionary(logs.read(spark, sf, "customer"), "c_mktsegment")


_NAMED = LOGS + """, named AS (
    SELECT message_id, CASE k % 5 WHEN 0 THEN subject WHEN 1 THEN '%RETRY%' || subject || '%g1' WHEN 2 THEN '%DEAD_RETRY%' || subject || '%g2' WHEN 3 THEN '%RETRY' ELSE NULL END AS subject FROM messages
)
"""


def _named(spark, sf):
    s = F.col("subject")
    kind = F.col("k") % 5
    name = F.when(kind == 0, s).when(kind == 1, subjects.retry_subject(s, F.lit("g1"))).when(kind == 2, subjects.dead_subject(s, F.lit("g2"))).when(kind == 3, subjects.RETRY)
    return logs.messages(spark, sf).select("message_id", name.alias("subject"))


@query(LOGS + "SELECT message_id, '%RETRY%' || subject || '%g1' AS retry, '%DEAD_RETRY%' || subject || '%g1' AS dead FROM messages")
def str1_derived_subjects(spark, sf):
    s, g = F.col("subject"), F.lit("g1")
    return logs.messages(spark, sf).select("message_id", subjects.retry_subject(s, g).alias("retry"), subjects.dead_subject(s, g).alias("dead"))


@query(_NAMED + "SELECT message_id, coalesce(starts_with(subject, '%RETRY'), false) AS retry, coalesce(starts_with(subject, '%DEAD_RETRY'), false) AS dead, subject IS NOT NULL AND NOT starts_with(subject, '%') AS real FROM named")
def str2_subject_kinds(spark, sf):
    s = F.col("subject")
    return _named(spark, sf).select("message_id", subjects.is_retry(s).alias("retry"), subjects.is_dead(s).alias("dead"), subjects.is_real(s).alias("real"))


@query(_NAMED + """SELECT message_id, CASE WHEN len(p) = 3 THEN p[2] ELSE subject END AS real, CASE WHEN len(p) = 3 THEN p[3] ELSE '' END AS grp, CASE WHEN len(p) = 3 THEN p[2] || '/' || p[3] END AS both_parts
FROM (SELECT *, CASE WHEN starts_with(subject, '%') THEN list_filter(string_split(subject, '%'), lambda x: x <> '') END AS p FROM named)""")
def str3_str4_subject_parts(spark, sf):
    s = F.col("subject")
    return _named(spark, sf).select("message_id", subjects.real_subject(s).alias("real"), subjects.group_of(s).alias("grp"), F.array_join(subjects.subject_and_group(s), "/").alias("both_parts"))


@query("SELECT p_partkey, p_name, p_name IS NULL OR p_name = '' OR regexp_matches(p_name, '[/\\s]') AS invalid FROM part")
def str5_invalid_subject(spark, sf):
    return logs.read(spark, sf, "part").select("p_partkey", "p_name", subjects.is_invalid(F.col("p_name")).alias("invalid"))


@query(LOGS + "SELECT client_id, least(client_key * 20, 10000) AS size, client_key > 0 AND client_key % 7 <> 0 AS valid FROM clients")
def str6_pull_validity(spark, sf):
    rows = logs.clients(spark, sf).withColumn("most", F.col("client_key") * 20)
    group = F.when(F.col("client_key") % 7 == 0, F.lit("a/b")).otherwise(F.col("group"))
    return rows.select("client_id", subjects.pull_size(F.col("most")).alias("size"), subjects.is_valid_pull(F.col("subject"), group, F.col("client_id"), F.col("most")).alias("valid"))


@query(LOGS + "SELECT client_id, client_id || '@' || \"group\" || '@' || subject AS joined, \"group\" AS second FROM clients")
def str7_consumer_keys(spark, sf):
    rows = logs.clients(spark, sf).select("client_id", subjects.consumer_key(F.col("client_id"), F.col("group"), F.col("subject")).alias("joined"))
    return rows.withColumn("second", subjects.split_key(F.col("joined"))[1])


@query(LOGS + "SELECT \"offset\", strftime(create_time, '%y%m%d') || '.' || strftime(create_time, '%H%M%S%g') || '.10.0.0.1.' || '77.' || \"offset\" AS id FROM messages")
def str8_message_id(spark, sf):
    return logs.messages(spark, sf).select("offset", subjects.message_id(F.col("create_time"), F.lit("10.0.0.1"), F.lit(77), F.col("offset")).alias("id"))


@query(LOGS + "SELECT message_id, subject || '%g0%' || message_id AS key FROM messages")
def str9_idempotency_key(spark, sf):
    return logs.messages(spark, sf).select("message_id", subjects.idempotency_key(F.col("subject"), F.lit("g0"), F.col("message_id")).alias("key"))


@query(LOGS + "SELECT client_id, 'tide://' || client_id || '?room=' || room || '&appCode=' || app_code AS endpoint, \"group\" || '_test_' || room AS isolated FROM clients")
def str10_str12_endpoint(spark, sf):
    c = F.col
    return logs.clients(spark, sf).select("client_id", subjects.endpoint(c("client_id"), c("room"), c("app_code")).alias("endpoint"), subjects.isolated_group(c("group"), F.lit("test"), c("room")).alias("isolated"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, '') AS round FROM part")
def str11_utf8(spark, sf):
    packed = F.when(F.col("p_partkey") % 3 > 0, F.encode("p_name", "UTF-8"))
    return logs.read(spark, sf, "part").select("p_partkey", subjects.text_or_empty(packed).alias("round"))


def _attributed(spark, sf):
    fields = {"k": F.when(F.col("k") % 4 != 0, F.col("k")), "user": F.col("user_id"), "hot": F.when(F.col("k") % 2 == 0, F.lit(True))}
    return logs.messages(spark, sf).select("message_id", attrs.as_attributes(fields).alias("attrs"))


@query(LOGS + "SELECT message_id, CAST(1 + CAST(k % 4 <> 0 AS BIGINT) + CAST(k % 2 = 0 AS BIGINT) AS BIGINT) AS n, CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) END AS k_text, CASE WHEN k % 4 <> 0 THEN k ELSE 0 END AS k_number, k % 2 = 0 AS hot FROM messages")
def map1_map2_attributes(spark, sf):
    a = F.col("attrs")
    return _attributed(spark, sf).select("message_id", F.size(a).cast("long").alias("n"), attrs.text(a, "k").alias("k_text"), attrs.number(a, "k").alias("k_number"), attrs.truth(a, "hot").alias("hot"))


@query("SELECT doc_id, greatest(CAST(ceil(length(text) / 8192.0) AS BIGINT), 1) AS n, substr(text, 1, 8192) AS first_part, text AS whole FROM documents")
def map3_large_text(spark, sf):
    pieces = logs.read(spark, sf, "documents").select("doc_id", attrs.parts(F.col("text"), 8192).alias("pieces"))
    return pieces.select("doc_id", F.size("pieces").cast("long").alias("n"), F.col("pieces")[0].alias("first_part"), attrs.joined(F.col("pieces")).alias("whole"))


@query(LOGS + "SELECT message_id, CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + 4 AS BIGINT) AS flag, k % 3 = 0 AS delayed, k % 2 = 0 AS reliable FROM messages")
def bit1_flags(spark, sf):
    k = F.col("k")
    rows = logs.messages(spark, sf).select("message_id", attrs.flags(k % 2 == 0, k % 3 == 0, F.lit(True)).cast("long").alias("flag"))
    return rows.select("*", attrs.has_flag(F.col("flag"), attrs.DELAY).alias("delayed"), attrs.has_flag(F.col("flag"), attrs.NOT_RELIABLE).alias("reliable"))


@query()
def crc1_checksums(spark, sf):
    return logs.read(spark, sf, "documents").select("doc_id", F.crc32("text").alias("crc"))


@query("SELECT o_orderkey, CAST(strftime(time_bucket(INTERVAL 15 MINUTE, o_orderdate + to_minutes(CAST(o_orderkey AS INTEGER) % 1440)), '%Y%m%d%H%M') AS BIGINT) AS bucket FROM orders")
def date1_schedule_bucket(spark, sf):
    time = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 AS int), 0)")
    return logs.read(spark, sf, "orders").select("o_orderkey", attrs.bucket(time, 15).alias("bucket"))


@query(LOGS + "SELECT message_id, epoch_ms(create_time) - epoch_ms(TIMESTAMP '2024-01-15 12:00:00') >= 500 AS late FROM messages")
def date2_delay_test(spark, sf):
    return logs.messages(spark, sf).select("message_id", attrs.is_delayed(F.col("create_time"), _now()).alias("late"))


@query(LOGS + "SELECT message_id FROM messages WHERE create_time BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-15 12:00:00'")
def date3_default_window(spark, sf):
    begin, end = attrs.search_window(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), _now())
    return logs.messages(spark, sf).filter(F.col("create_time").between(begin, end)).select("message_id")


@query(LOGS + "SELECT subject, seq, message_id FROM messages WHERE list_has_any(tags, ['k1', 'p2'])")
def f1_tag_or(spark, sf):
    return filters.keep(logs.messages(spark, sf), [filters.tag_filter("OR", ["k1", "p2"], F.col("tags"))]).select(*_MSG)


@query(LOGS + "SELECT subject, seq, message_id FROM messages WHERE list_has_all(tags, ['k1', 'p2'])")
def f1_tag_and(spark, sf):
    return filters.keep(logs.messages(spark, sf), [filters.tag_filter("AND", ["k1", "p2"], F.col("tags"))]).select(*_MSG)


_ENV_SQL = ", ruled AS (SELECT *, 'g' || (k % 2) AS grp, CASE WHEN k % 3 = 0 THEN 'prod' ELSE 'test' END AS env, 's' || (user_id % 4) AS sub_env FROM messages)\n"


@query(LOGS + _ENV_SQL + "SELECT message_id FROM ruled WHERE (subject, grp, env, sub_env) IN (('click', 'g0', 'test', 's1'), ('click', 'g1', 'prod', 's2'), ('view', 'g0', 'test', 's0'))")
def f2_environment_rules(spark, sf):
    k = F.col("k")
    rows = logs.messages(spark, sf).select("message_id", "subject", F.concat(F.lit("g"), k % 2).alias("group"), F.when(k % 3 == 0, "prod").otherwise("test").alias("env"), F.concat(F.lit("s"), F.col("user_id") % 4).alias("sub_env"))
    rules = [("click", "g0", "test", "s1"), ("click", "g1", "prod", "s2"), ("view", "g0", "test", "s0"), ("error", "g0", "", "s1"), ("error", "g1", "test", None)]
    return filters.by_env_rules(rows, spark.createDataFrame(rules, "subject string, group string, env string, sub_env string")).select("message_id")


@query(LOGS + "SELECT message_id FROM messages WHERE list_has_any(tags, ['k1']) AND 's' || (user_id % 4) = 's1' AND k % 3 <> 0")
def f3_filter_chain(spark, sf):
    rows = logs.messages(spark, sf).withColumn("env", F.when(F.col("k") % 3 == 0, "prod").otherwise("test")).withColumn("sub_env", F.concat(F.lit("s"), F.col("user_id") % 4))
    chain = [filters.tag_filter("OR", ["k1"], F.col("tags")), filters.tag_filter("NO_TAG", ["k9"], F.col("tags")), filters.env_filter("test", "s1", F.col("env"), F.col("sub_env"))]
    return filters.keep(rows, chain).select("message_id")


@query(LOGS + """, kept AS (SELECT subject, seq, seq - row_number() OVER (PARTITION BY subject ORDER BY seq) AS island FROM messages WHERE list_has_any(tags, ['k1', 'p2']))
SELECT subject, min(seq) AS lo, max(seq) AS hi, count(*) AS n FROM kept GROUP BY subject, island
UNION ALL SELECT subject, max(seq), max(seq), 0 FROM messages GROUP BY subject""")
def f4_kept_ranges(spark, sf):
    rows = logs.messages(spark, sf)
    return filters.kept_ranges(rows, [filters.tag_filter("OR", ["k1", "p2"], F.col("tags"))], ["subject"])


@query(LOGS + "SELECT subject, seq FROM messages m WHERE seq < (SELECT min(seq) FROM messages b WHERE b.subject = m.subject AND b.k % 50 = 7)")
def f5_ready_prefix(spark, sf):
    rows = logs.messages(spark, sf)
    return filters.ready_prefix(rows, ["subject"], "seq", F.col("k") % 50 != 7).select("subject", "seq")


@query(LOGS + "SELECT message_id, CASE WHEN k % 13 = 0 THEN 'corrupt' WHEN times > 1 THEN 'redelivered' WHEN k % 5 = 0 THEN 'other_group' ELSE 'delivered' END AS outcome FROM messages")
def f6_consumer_outcome(spark, sf):
    rows = logs.messages(spark, sf).withColumn("corrupt", F.col("k") % 13 == 0).withColumn("bound_group", F.when(F.col("k") % 5 == 0, "g9"))
    return filters.consumer_outcome(rows, True, "g0").select("message_id", "outcome")


@query(LOGS + "SELECT message_id, CASE WHEN k % 11 = 0 THEN 'empty' WHEN k % 4 = 0 THEN 'illegal' ELSE 'ok' END AS verdict FROM messages")
def f8_validation(spark, sf):
    k = F.col("k")
    rows = logs.messages(spark, sf).withColumn("subject", F.when(k % 11 == 0, "").when(k % 4 == 0, "a /b").otherwise(F.col("subject")))
    return filters.validated(rows).select("message_id", "verdict")


@query("SELECT o_orderkey, CAST(greatest(least(o_orderdate, TIMESTAMP '1996-01-01' + INTERVAL 730 DAY), TIMESTAMP '1996-01-01') AS TIMESTAMP) AS at FROM orders")
def f9_f10_delay_clamps(spark, sf):
    return logs.read(spark, sf, "orders").select("o_orderkey", attrs.clamped(F.col("o_orderdate"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).alias("at"))


@query(_NAMED + "SELECT message_id FROM named WHERE NOT coalesce(starts_with(subject, '%DEAD_RETRY'), false) AND coalesce(subject, '') NOT IN ('click', '%RETRY')")
def f11_skip_list(spark, sf):
    skipped = spark.createDataFrame([("click",), ("%RETRY",)], "subject string")
    return filters.without(_named(spark, sf), skipped).select("message_id")


@query("""SELECT id, CASE WHEN id % 9 = 0 THEN 'too many errors' WHEN id % 7 = 0 THEN 'no subject' WHEN id % 5 = 0 THEN 'placeholder' ELSE 'send' END AS action
FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '1999-12-31 23:59:00' ORDER BY o_orderkey LIMIT 50)""")
def f12_outbox_compensation(spark, sf):
    i = F.col("o_orderkey")
    content = F.when(i % 7 == 0, F.lit("{}")).when(i % 5 == 0, F.lit('{"subject": "${a}"}')).otherwise(F.lit('{"subject": "s"}'))
    rows = logs.read(spark, sf, "orders").select(i.alias("id"), content.alias("content"), F.when(i % 2 == 0, 0).otherwise(-100).alias("status"), F.when(i % 9 == 0, 1000).otherwise(0).alias("error"), F.col("o_orderdate").alias("update_time"))
    return filters.to_compensate(rows, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("id", "action")


@query(_CODES + "SELECT row_key FROM (SELECT code || inverted || md5(message_id) AS row_key FROM dated) WHERE row_key >= '000001' AND row_key < '000003' AND regexp_matches(row_key, '^[0-9 ]{18}[a-f]') ORDER BY row_key LIMIT 25")
def src12_f13_key_scan(spark, sf):
    from tidelog.operators.history import scan_keys

    return scan_keys(k1_message_key(spark, sf).select("row_key"), "row_key", "000001", "000003", "^[0-9 ]{18}[a-f]", 25)


@query(LOGS + 'SELECT subject, seq, message_id FROM messages WHERE subject = \'view\' AND seq >= 5 ORDER BY seq LIMIT 30')
def o4_prefix_read(spark, sf):
    rows = logs.messages(spark, sf).filter("subject = 'view' AND seq >= 5")
    return sequence.read_prefix(rows, ["seq"], 30).select(*_MSG)


@query(LOGS + "SELECT seq, given FROM (SELECT seq, CAST(sum(k) OVER (ORDER BY seq) AS BIGINT) AS given FROM (SELECT * FROM messages WHERE subject = 'view' ORDER BY seq LIMIT 30)) WHERE given <= 900")
def o4_prefix_by_size(spark, sf):
    rows = sequence.read_prefix(logs.messages(spark, sf).filter("subject = 'view'").select("seq", "k"), ["seq"], 30, "k", 900)
    from pyspark.sql import Window

    return rows.select("seq", F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("seq")).alias("given"))


@query(LOGS + 'SELECT subject, "group", consumer_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY subject, "group", consumer_id ORDER BY lo, hi) AS run FROM (SELECT subject, "group", consumer_id, first_pull AS lo, last_pull AS hi, CASE WHEN first_pull <= max(last_pull) OVER (PARTITION BY subject, "group", consumer_id ORDER BY first_pull, last_pull ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM acks)) GROUP BY subject, "group", consumer_id, run')
def o3_merged_ranges(spark, sf):
    return sequence.merged_ranges(logs.acks(spark, sf), ["subject", "group", "consumer_id"], "first_pull", "last_pull")


@query(LOGS + "SELECT message_id, (SELECT min(message_id) FROM (SELECT message_id FROM messages WHERE message_id >= 'm2' ORDER BY message_id LIMIT 1 OFFSET 40)) AS next_key FROM messages WHERE message_id >= 'm2' ORDER BY message_id LIMIT 40")
def o5_keyset_page(spark, sf):
    return sequence.page(logs.messages(spark, sf).select("message_id"), "message_id", 40, "m2")


@query(LOGS + 'SELECT subject, seq // 100 AS batch, max("offset") AS "offset", arg_max(message_id, "offset") AS message_id FROM messages GROUP BY 1, 2')
def o6_batch_tail(spark, sf):
    rows = sequence.batches(logs.messages(spark, sf), "seq", 100)
    return sequence.latest_of_batch(rows, ["subject", "batch"], "offset", "message_id")


@query(LOGS + "SELECT subject, seq // 50 AS batch, count(*) AS n FROM messages GROUP BY 1, 2")
def o8_batches(spark, sf):
    return sequence.batches(logs.messages(spark, sf), "seq", 50).groupBy("subject", "batch").agg(F.count("*").alias("n"))


@query(LOGS + "SELECT message_id, list_contains(tags, 'k1') AS has, list_has_all(tags, ['k1', 'p1']) AS every, list_has_any(tags, ['p0', 'p1']) AS some FROM messages")
def u1_list_predicates(spark, sf):
    t = F.col("tags")
    return logs.messages(spark, sf).select("message_id", F.array_contains(t, "k1").alias("has"), (F.size(F.array_except(F.array(F.lit("k1"), F.lit("p1")), t)) == 0).alias("every"), F.arrays_overlap(t, F.array(F.lit("p0"), F.lit("p1"))).alias("some"))
