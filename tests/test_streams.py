"""Streams over files give what the batch operators give."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidelog.operators import delivery
from tidelog.sources import logs
from tidelog.streaming import streams


@pytest.fixture()
def folder(tmp_path):
    yield str(tmp_path)
    shutil.rmtree(tmp_path, ignore_errors=True)


def drain(df, folder):
    streams.drained(df, streams.append_once(f"{folder}/out"), f"{folder}/checkpoint")
    return df.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def test_sequences_go_on_over_batches(spark, sf_dir, folder):
    rows = logs.messages(spark, sf_dir).filter("offset < 300").select("subject", "offset", "seq")
    for part in range(3):
        rows.filter((F.col("offset") / 100).cast("int") == part).select("subject", "offset").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streams.log_stream(spark, f"{folder}/in", "subject string, offset long", files=1)
    writer = streams.append_sequenced(f"{folder}/out", ["subject"], "offset")
    streams.drained(stream, writer, f"{folder}/checkpoint")
    found = spark.read.parquet(f"{folder}/out/rows")
    assert found.select("batch").distinct().count() == 3
    assert sorted((r.subject, r.seq) for r in found.collect()) == sorted((r.subject, r.seq) for r in rows.collect())
    last = spark.createDataFrame(found.filter("batch = 2").select("subject", "offset").collect(), "subject string, offset long")
    writer(last, 2)  # a batch that runs again replaces itself
    assert spark.read.parquet(f"{folder}/out/rows").count() == rows.count()


def test_each_key_is_handled_once(spark, folder):
    for part in range(3):
        spark.createDataFrame([(k, part) for k in range(part, part + 4) for _ in range(2)], "key long, n long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streams.log_stream(spark, f"{folder}/in", "key long, n long", files=1)
    writer = streams.process_once(f"{folder}/out", ["key"], lambda rows: rows.withColumn("done", F.lit(True)))
    streams.drained(stream, writer, f"{folder}/checkpoint")
    assert sorted(r.key for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(6))
    writer(spark.createDataFrame([(5, 9), (7, 9)], "key long, n long"), 3)
    writer(spark.createDataFrame([(5, 9), (7, 9)], "key long, n long"), 3)
    assert sorted(r.key for r in spark.read.parquet(f"{folder}/out").collect()) == [*range(6), 7]


def test_ack_records_as_in_batch(spark, sf_dir, folder):
    pulls, acks = logs.pulls(spark, sf_dir), logs.acks(spark, sf_dir)
    pulls.write.parquet(f"{folder}/pulls")
    acks.write.parquet(f"{folder}/acks")
    found = streams.ack_records(streams.log_stream(spark, f"{folder}/pulls", pulls.schema, 100), streams.log_stream(spark, f"{folder}/acks", acks.schema, 100))
    out = drain(found, folder).select("subject", "group", "consumer_id", "pull_seq", "seq")
    want = delivery.ack_records(acks, delivery.deliveries(pulls)).select("subject", "group", "consumer_id", "pull_seq", "seq")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_first_of_each_key(spark, folder):
    rows = [(k % 5, k) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, n long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = drain(streams.once(streams.log_stream(spark, f"{folder}/in", df.schema), ["key"], "ts", "1 hour"), folder)
    assert sorted(r.key for r in out.collect()) == [0, 1, 2, 3, 4]


def test_minutes_close_with_the_watermark(spark, folder):
    df = spark.createDataFrame([("a", 0), ("a", 20), ("b", 70), ("a", 1000)], "tag string, s long").select("tag", F.timestamp_seconds(F.lit(1_700_000_040) + F.col("s")).alias("ts"))
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = drain(streams.requests_per_minute(streams.log_stream(spark, f"{folder}/in", df.schema), ["tag"], "ts"), folder)
    assert sorted((r.tag, r.requests) for r in out.collect()) == [("a", 2), ("b", 1)]


def test_breaker_opens_and_closes(spark, folder):
    calls = [("x", t, False) for t in range(3)] + [("x", 10 + t, True) for t in range(2)] + [("y", t, t % 2 == 0) for t in range(20)]
    df = spark.createDataFrame(calls, "broker string, s long, ok boolean").select("broker", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "ok")
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = drain(streams.breaker_states(streams.log_stream(spark, f"{folder}/in", df.schema), "broker", "ts", failures=3, successes=2), folder)
    assert sorted((r.broker, r.state, r.at.second) for r in out.collect()) == [("x", "closed", 31), ("x", "half-open", 30), ("x", "open", 22)]


def test_clients_come_and_go(spark, folder):
    beats = [("a", 0), ("b", 0), ("b", 100), ("b", 400)]
    df = spark.createDataFrame(beats, "client string, s long").select("client", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"))
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = drain(streams.liveness_changes(streams.log_stream(spark, f"{folder}/in", df.schema), "client", "ts"), folder)
    # b is heard of once more at 400, more than three minutes later, but in the same batch: it was never given out as offline
    assert sorted((r.client, r.status) for r in out.collect()) == [("a", "offline"), ("a", "online"), ("b", "online")]
