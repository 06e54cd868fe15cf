"""Searches in the history of messages and of what was done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import subjects


def scan_keys(rows: DataFrame, key: str, low: str, high: str, pattern: str, most: int) -> DataFrame:
    """The first rows of a key range (the end excluded) whose key matches a pattern."""
    return rows.filter((F.col(key) >= low) & (F.col(key) < high) & F.rlike(F.col(key), F.lit(pattern))).orderBy(key).limit(most)


def find_messages(log: DataFrame, subject: str, begin: Column, end: Column, most: int, message_id: str | None = None) -> DataFrame:
    """A subject's newest messages between two times (both included); with an id only that one."""
    rows = log.filter((F.col("subject") == subject) & (F.col("create_time") >= begin) & (F.col("create_time") <= end))
    if message_id is not None:
        rows, most = rows.filter(F.col("message_id") == message_id), 1
    return rows.orderBy(F.desc("create_time"), F.desc("seq")).limit(most)


def find_dead(log: DataFrame, subject: str, group: str | None, most: int) -> DataFrame:
    """The newest dead messages of a subject, of one group or of all."""
    dead = log.filter(subjects.is_dead(F.col("subject")) & (subjects.real_subject(F.col("subject")) == subject))
    if group is not None:
        dead = dead.filter(subjects.group_of(F.col("subject")) == group)
    return dead.orderBy(F.desc("create_time"), F.desc("message_id"), "subject").limit(most)


def trail(records: DataFrame, keys: DataFrame) -> DataFrame:
    """All pulls and acks of the messages (subject, seq)."""
    return records.join(keys.select("subject", "seq").distinct(), ["subject", "seq"], "left_semi")


def retry_metas(index: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The retry messages of the last days, once each however often they are indexed."""
    recent = (F.col("create_time") > now - F.make_dt_interval(days=F.lit(days))) & (F.col("create_time") <= now)
    return index.filter(subjects.is_retry(F.col("subject")) & recent).select("message_id", "subject", "seq").distinct()


def dead_trail(records: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(message_id, seq, at, group) of the dead records (row_key, value) of wanted messages (code, message_id), so many of each at most."""
    begin = wanted.select("message_id", F.concat("code", F.md5("message_id")).alias("_begin")).distinct()
    met = records.withColumn("_begin", F.substring("row_key", 1, 38)).join(begin, "_begin")
    first = met.withColumn("_place", F.row_number().over(Window.partitionBy("_begin").orderBy("row_key"))).filter(F.col("_place") <= most)
    part = F.split("value", r"\|", 3)
    return first.select("message_id", part[0].cast("long").alias("seq"), F.timestamp_millis(part[1].cast("long")).cast("timestamp_ntz").alias("at"), part[2].alias("group"))


def retry_trail(log: DataFrame, records: DataFrame, ids: DataFrame) -> DataFrame:
    """Pulls and acks of the retry messages with the given ids."""
    metas = log.filter(subjects.is_retry(F.col("subject"))).join(ids, "message_id", "left_semi").select("subject", "seq").distinct()
    return records.join(metas, ["subject", "seq"], "left_semi")
