"""Retries and dead messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import subjects
from tidelog.operators.delivery import shuffled
from tidelog.operators.progress import CONSUMER


def with_default_retries(df: DataFrame, default: int = 32) -> DataFrame:
    """The rows with max_retry set where it is missing or negative."""
    return df.withColumn("max_retry", F.when(F.col("max_retry") >= 0, F.col("max_retry")).otherwise(default).cast("long"))


def sent_back(failed: DataFrame, now: str) -> DataFrame:
    """Failed messages of (subject, group, times, max_retry) under the subject they go to next.

    One more failure than allowed makes a message dead; otherwise it is to be consumed again. Its
    count goes up and its creation time is that of sending it back.
    """
    real, group = subjects.real_subject(F.col("subject")), F.col("group")
    over = F.col("times") + 1 > F.col("max_retry")
    target = F.when(over, subjects.dead_subject(real, group)).otherwise(subjects.retry_subject(real, group))
    return failed.withColumns({"target": target, "dead": over, "times": F.col("times") + 1, "create_time": F.lit(now).cast("timestamp_ntz")})


def retry_action(delay_ms: Column, times: Column, max_retry: Column, local: int = 50) -> Column:
    """What happens to a message that asks for a later retry: `local`, `delayed` or `failed`."""
    return F.when(max_retry < times + 1, "failed").when(delay_ms <= local, "local").otherwise("delayed")


def of_silent(delivered: DataFrame, progress: DataFrame, status: DataFrame) -> DataFrame:
    """Messages that consumers who are not online have pulled and not acked, under the retry subject of their group."""
    silent = status.filter("status <> 'online'").select(*CONSUMER).join(progress.select(*CONSUMER, "ack"), CONSUMER)
    left = shuffled(delivered).join(silent, CONSUMER).filter(F.col("pull_seq") > F.col("ack"))
    return left.select(subjects.retry_subject(F.col("subject"), F.col("group")).alias("subject"), "consumer_id", "pull_seq", "seq")


def silent_actions(progress: DataFrame, status: DataFrame) -> DataFrame:
    """(consumer, status, action): what is left goes to `retry`; consumers gone for ever with nothing left are to `unsubscribe`."""
    done = F.col("ack") >= F.col("pull")
    action = F.when((F.col("status") == "forever") & done, "unsubscribe").when(F.col("status") == "online", "none").otherwise("retry")
    return progress.join(status.select(*CONSUMER, "status"), CONSUMER).select(*CONSUMER, "status", action.alias("action"))


def breaker_walk(state: tuple[str, int, int, int], ms: np.ndarray, ok: np.ndarray, failures: int, open_ms: int, successes: int) -> tuple[tuple[str, int, int, int], list[tuple[int, str]]]:
    """A circuit breaker after calls in order, and its changes (call, new state); goes from change to change, not from call to call.

    The state is (name, failures in a row, successes since half open, when it opened).
    """
    name, bad, good, opened = state
    places = np.arange(len(ok))
    good_before = np.maximum.accumulate(np.where(ok, places, -1))  # the last success up to each call
    failed = np.flatnonzero(~ok)
    at, changes = 0, []
    while at < len(ok):
        if name == "closed":
            since = np.where(good_before[at:] >= at, places[at:] - good_before[at:], places[at:] - at + 1 + bad)
            full = np.flatnonzero(since >= failures)
            if not len(full):
                bad = int(since[-1])
                break
            at += int(full[0])
            name, bad, opened = "open", 0, int(ms[at])
        elif name == "open":
            at = max(at, int(np.searchsorted(ms, opened + open_ms)))
            if at >= len(ok):
                break
            name, good = "half-open", 0
            changes.append((at, name))
            continue
        else:
            k = int(np.searchsorted(failed, at))
            fail = int(failed[k]) if k < len(failed) else len(ok)
            if at + successes - good <= fail:
                at += successes - good - 1
                name, bad, good = "closed", 0, 0
            elif fail < len(ok):
                at, name, opened, good = fail, "open", int(ms[fail]), 0
            else:
                good += len(ok) - at
                break
        changes.append((at, name))
        at += 1
    return (name, bad, good, opened), changes


def breaker_changes(calls: DataFrame, key: str, time: str, order: str, failures: int = 100, open_ms: int = 5000, successes: int = 20) -> DataFrame:
    """(key, state, at) whenever a key's circuit breaker changes: so many failures in a row open it for a time, then so many successes close it.

    Each call depends on those before, so a key's calls are walked through in one task, batch by batch
    and in order of (time, order); only the state is held.
    """
    rows = calls.select(F.col(key).alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.col(order).alias("n"), "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, ("closed", 0, 0, 0)
        for batch in batches:
            names = batch.column(0).to_pylist()
            ms, ok = batch.column(1).to_numpy(), batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if names[a] != current:
                    current, state = names[a], ("closed", 0, 0, 0)
                state, changes = breaker_walk(state, ms[a:b], ok[a:b], failures, open_ms, successes)
                yield pa.record_batch([pa.array([current] * len(changes), pa.string()), pa.array([x for _, x in changes], pa.string()), pa.array([int(ms[a + i]) for i, _ in changes], pa.int64())], ["key", "state", "ms"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "ms", "n").select("key", "ms", "ok")
    found = dealt.mapInArrow(run, "key string, state string, ms long")
    return found.select(F.col("key").alias(key), "state", F.timestamp_millis("ms").cast("timestamp_ntz").alias("at"))


def subjects_to_read(consumers: DataFrame) -> DataFrame:
    """(subject, group, read): a group reads its subject and, unless that is a dead one, its retry subject."""
    both = F.when(subjects.is_dead(F.col("subject")), F.array("subject")).otherwise(F.array(subjects.retry_subject(subjects.real_subject(F.col("subject")), F.col("group")), F.col("subject")))
    return consumers.select("subject", "group", F.explode(both).alias("read"))
