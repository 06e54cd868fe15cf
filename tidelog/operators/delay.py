"""Delayed messages: time buckets, what is due, and how exact dispatch is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import attrs


def bucketed(delayed: DataFrame, minutes: int = 60) -> DataFrame:
    return delayed.withColumn("bucket", attrs.bucket(F.col("schedule_time"), minutes))


def undispatched(scheduled: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Scheduled messages without a dispatch in their bucket."""
    return scheduled.join(dispatched.select("bucket", "seq"), ["bucket", "seq"], "left_anti")


def payloads(index: DataFrame, delayed: DataFrame) -> DataFrame:
    """The delayed messages of index rows (seq); rows without a message are skipped."""
    return delayed.join(index.select("seq"), "seq", "left_semi")


def loadable(scheduled: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Messages of the buckets to be held in memory by now: up to half a bucket ahead, whole buckets."""
    ahead = now + F.make_dt_interval(mins=F.lit(minutes // 2))
    return scheduled.filter(F.col("bucket") <= attrs.bucket(ahead, minutes))


def added_directly(late: DataFrame, loaded_bucket: int, cursor: int) -> DataFrame:
    """Messages that arrive after their bucket was loaded: earlier buckets, or the loaded one from the cursor on."""
    return late.withColumn("direct", (F.col("bucket") < loaded_bucket) | ((F.col("bucket") == loaded_bucket) & (F.col("seq") <= cursor)))


def ticks(due: DataFrame, now: Column, tick: int = 500) -> DataFrame:
    """The tick of the wheel at which a message is due, counted from now (late: 0)."""
    ahead = F.greatest(attrs.millis(F.col("schedule_time")) - attrs.millis(now), F.lit(0))
    return due.withColumn("tick", F.ceil(ahead / tick).cast("long"))


def after_send(batch: DataFrame, failed: DataFrame) -> DataFrame:
    """A sent batch with `outcome`: `dispatched` rows go to the dispatch log, `again` rows are sent once more."""
    marked = batch.join(failed.select("seq").distinct().withColumn("_failed", F.lit(True)), "seq", "left")
    return marked.withColumn("outcome", F.when(F.col("_failed"), "again").otherwise("dispatched")).drop("_failed")


def expired_buckets(rows: DataFrame, now: Column, hours: int) -> DataFrame:
    """Buckets that retention may delete."""
    return rows.select("bucket").distinct().filter(F.col("bucket") < attrs.bucket(now - F.make_dt_interval(hours=F.lit(hours))))
