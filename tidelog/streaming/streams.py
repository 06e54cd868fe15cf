"""Log operators on unbounded input. Times are cast to timestamps with a zone (UTC), which watermarks need.

Sequences, joins and states agree with the batch operators once all input is read; what a stream
holds is bounded by its watermark or by the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.delivery import acked_places, deliveries
from tidelog.operators.progress import CONSUMER
from tidelog.operators.retry import breaker_walk
from tidelog.operators.sequence import with_sequence


def log_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A growing folder of Parquet files as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_sequenced(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A writer that numbers the rows of each key (`seq`), on from batch to batch and in the given order inside a batch.

    Rows go to path/rows/batch=n and the number that each key goes on with to path/next/batch=n, so a
    batch that runs again finds what it found before and replaces itself. Rows that come late are
    numbered when they come.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = with_sequence(batch, keys, order)
        ends = rows.groupBy(*keys).agg((F.max("seq") + 1).alias("more"))
        known = spark.read.parquet(f"{path}/next/batch={number - 1}") if number else spark.createDataFrame([], ends.withColumnRenamed("more", "next").schema)
        same = [batch[k].eqNullSafe(known[k]) for k in keys]
        begun = rows.join(known.select(*keys, "next"), reduce(and_, same), "left").select(*(rows[c] for c in batch.columns), (rows["seq"] + F.coalesce(known["next"], F.lit(0))).alias("seq"))
        begun.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        both = known.select(*keys, F.col("next")).unionByName(ends.withColumnRenamed("more", "next"))
        both.groupBy(*keys).agg(F.sum("next").alias("next")).write.mode("overwrite").parquet(f"{path}/next/batch={number}")

    return write


def process_once(path: str, key: list[str], handle: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A writer that handles each key once: a batch's results and their keys are one write, which later batches look into.

    As results and keys stand or fall together, no key is handled twice or lost, whichever batch is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        if number:
            done = spark.read.parquet(*(f"{path}/batch={n}" for n in range(number))).select(*key)
            fresh = fresh.join(done, key, "left_anti")
        handle(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def once(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Idempotent consumption: the first row of each key, keys being forgotten behind the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def ack_records(pulls: DataFrame, acks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Acked messages with their sequence: acks meet the pulls of at most `delay` before or after them; others are dropped."""
    left = deliveries(pulls.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("pull_ts", delay)
    right = acked_places(acks.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ack_ts", delay)
    right = right.select(*(F.col(x).alias(f"_{x}") for x in (*CONSUMER, "pull_seq")), "ack_ts")
    same = [F.col(x) == F.col(f"_{x}") for x in (*CONSUMER, "pull_seq")]
    near = F.expr(f"ack_ts BETWEEN pull_ts - INTERVAL {delay} AND pull_ts + INTERVAL {delay}")
    condition = near
    for c in same:
        condition = condition & c
    return left.join(right, condition).select(*CONSUMER, "pull_seq", "seq", "pull_ts", "ack_ts")


def requests_per_minute(stream: DataFrame, tags: list[str], time: str, delay: str = "1 minute") -> DataFrame:
    """(tags, minute, requests), a minute being given out once the watermark has passed it."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.groupBy(*tags, F.window(time, "1 minute")).agg(F.count("*").alias("requests")).select(*tags, F.col("window.start").alias("minute"), "requests")


def liveness_changes(beats: DataFrame, key: str, time: str, silent_ms: int = 180_000, delay: str = "10 seconds") -> DataFrame:
    """(key, status, at): `online` when a client is first heard of or comes back, `offline` once the watermark leaves it silent for so long."""

    def follow(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "status": ["offline"], "at": [pd.Timestamp(last, unit="ms")]})
            return
        seen = pd.concat([f[time] for f in frames])
        last = int(seen.max().timestamp() * 1000)
        fresh = not state.exists
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silent_ms, state.getCurrentWatermarkMs() + 1))
        if fresh:
            yield pd.DataFrame({key: [keys[0]], "status": ["online"], "at": [seen.min()]})

    rows = beats.select(key, F.col(time).cast("timestamp").alias(time)).withWatermark(time, delay)
    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} string, status string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_states(calls: DataFrame, key: str, time: str, failures: int = 100, open_ms: int = 5000, successes: int = 20) -> DataFrame:
    """(key, state, at) whenever a circuit breaker changes: so many failures in a row open it for a time, then so many successes close it.

    `calls` has `ok` (boolean); a key's calls of a batch are taken in order of time.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        ms = rows[time].to_numpy().astype("datetime64[ms]").astype(np.int64)
        now, changes = breaker_walk(state.get if state.exists else ("closed", 0, 0, 0), ms, rows["ok"].to_numpy(bool), failures, open_ms, successes)
        state.update(now)
        yield pd.DataFrame({key: [keys[0]] * len(changes), "state": [x for _, x in changes], "at": [rows[time].iloc[i] for i, _ in changes]})

    rows = calls.select(key, F.col(time).cast("timestamp").alias(time), "ok")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, state string, at timestamp", "now string, bad long, good long, opened long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all input there is; `write` gets each batch with its number, to be applied once."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that puts each batch into a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
