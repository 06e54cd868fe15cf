"""How far groups and consumers have come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.sequence import running_max

GROUP = ["subject", "group"]
CONSUMER = ["subject", "group", "consumer_id"]


def bounds(log: DataFrame) -> DataFrame:
    """(subject, min_seq, max_seq, max_offset)."""
    return log.groupBy("subject").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.max("offset").alias("max_offset"))


def group_progress(pulls: DataFrame) -> DataFrame:
    return pulls.groupBy(*GROUP).agg(F.max("last_msg").alias("max_pulled"))


def consumer_progress(pulls: DataFrame, acks: DataFrame) -> DataFrame:
    """(consumer, pull, ack): the last pulled and acked places; acks of consumers that never pulled do not count."""
    pulled = pulls.groupBy(*CONSUMER).agg(F.max("last_pull").alias("pull"))
    acked = acks.groupBy(*CONSUMER).agg(F.max("last_pull").alias("ack"))
    return pulled.join(acked, CONSUMER, "left").withColumn("ack", F.coalesce("ack", F.lit(-1)))


def skips(actions: DataFrame, keys: list[str], lo: str, hi: str, order: str) -> DataFrame:
    """Actions that begin after the place that should follow what was seen before, with `missing` places."""
    seen = running_max(actions, keys, [order], hi, "_before")
    return seen.withColumn("missing", F.col(lo) - F.col("_before") - 1).drop("_before").filter("missing > 0")


def lag(log: DataFrame, pulls: DataFrame) -> DataFrame:
    """(subject, group, lag): messages that a group has yet to pull."""
    ends = log.groupBy("subject").agg(F.max("seq").alias("max_seq"))
    return group_progress(pulls).join(ends, "subject").select(*GROUP, (F.col("max_seq") - F.col("max_pulled")).alias("lag"))


def replay_lag(log: DataFrame, replayed: DataFrame) -> DataFrame:
    """(replayer, behind) of rows (replayer, iterated): offsets of the log that are not replayed yet."""
    return replayed.select(*(c for c in replayed.columns if c != "iterated"), (log.agg(F.max("offset")).scalar() - F.col("iterated")).alias("behind"))


def unacked(progress: DataFrame) -> DataFrame:
    return progress.select(*CONSUMER, (F.col("pull") - F.col("ack")).alias("unacked"))


def start_of(groups: DataFrame, progress: DataFrame, ends: DataFrame) -> DataFrame:
    """(subject, group, start): a group goes on after what it has pulled, a new one starts behind the last message."""
    known = groups.join(progress, GROUP, "left").join(ends.select("subject", "max_seq"), "subject")
    return known.select(*GROUP, (F.coalesce("max_pulled", "max_seq") + 1).alias("start"))


def reset(ends: DataFrame, where: str) -> DataFrame:
    """(subject, start) of a group set to the earliest or behind the latest message."""
    return ends.select("subject", F.col("min_seq" if where == "earliest" else "max_seq").alias("seq")).select("subject", (F.col("seq") + (0 if where == "earliest" else 1)).alias("start"))


def read_position(start: Column, low: Column, high: Column, strict: bool = False) -> tuple[Column, Column]:
    """Where a read begins, and its status; `high` is the place behind the last message."""
    status = F.when(start < 0, "to end").when(start > high, "overflow").when(start == high, "nothing").when(start < low, "too small").otherwise("found")
    at = F.when((start < 0) | (start > high), high).when((start < low) & F.lit(not strict), low).otherwise(start)
    return at, status


def expired(groups: DataFrame, ends: DataFrame) -> DataFrame:
    """(subject, group, expired): messages that retention removed before the group came to them."""
    jumped = F.greatest(F.col("min_seq") - F.col("max_pulled") - 1, F.lit(0))
    return groups.join(ends, "subject").select(*GROUP, jumped.cast("long").alias("expired"))


def nested(progress: DataFrame) -> DataFrame:
    """(subject, group, consumers): a map from consumer to its places."""
    entry = F.struct("consumer_id", F.struct("pull", "ack"))
    return progress.groupBy(*GROUP).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("consumers"))
