"""Pulled and acked messages, and what is delivered again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import subjects
from tidelog.operators.progress import CONSUMER
from tidelog.operators.sequence import gaps, ranges, running_sum


def deliveries(pulls: DataFrame) -> DataFrame:
    """One row per pulled message: the consumer, the place in its pulls, and the message's sequence."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_pull") - F.col("first_pull")))
    return pulls.withColumn("_step", steps).select(*CONSUMER, (F.col("first_pull") + F.col("_step")).alias("pull_seq"), (F.col("first_msg") + F.col("_step")).alias("seq"), F.col("ts").alias("pull_ts"))


def shuffled(rows: DataFrame) -> DataFrame:
    """Deliveries or messages to be joined by sorting.

    Spark takes deliveries to be no more than the pulls they are exploded from, and messages to be as
    large as their compressed columns, and would broadcast both.
    """
    return rows.hint("merge")


def with_messages(delivered: DataFrame, log: DataFrame, *columns: str) -> DataFrame:
    """Deliveries with columns of their messages."""
    return shuffled(delivered).join(log.select("subject", "seq", *columns), ["subject", "seq"])


def assigned(taken: DataFrame, order: str, broadcast: Column) -> DataFrame:
    """Messages taken by consumers (first_msg, last_msg) with their places in the consumer's pulls.

    Places go on from the last pull; in broadcast mode they are those of the messages.
    """
    counted = running_sum(taken.withColumn("_n", F.col("last_msg") - F.col("first_msg") + 1), CONSUMER, [order], "_n", "_upto")
    first = F.when(broadcast, F.col("first_msg")).otherwise(F.col("_upto") - F.col("_n"))
    last = F.when(broadcast, F.col("last_msg")).otherwise(F.col("_upto") - 1)
    return counted.withColumns({"first_pull": first, "last_pull": last}).drop("_n", "_upto")


def translated(requests: DataFrame, delivered: DataFrame) -> DataFrame:
    """Wanted (consumer, pull_seq) with the message's sequence, -1 where nothing was pulled there."""
    return requests.join(shuffled(delivered).select(*CONSUMER, "pull_seq", "seq"), [*CONSUMER, "pull_seq"], "left").withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))


def acked_places(acks: DataFrame) -> DataFrame:
    places = F.explode(F.sequence("first_pull", "last_pull"))
    return acks.select(*CONSUMER, places.alias("pull_seq"), F.col("ts").alias("ack_ts"))


def ack_records(acks: DataFrame, delivered: DataFrame) -> DataFrame:
    """Acked messages by their sequence; acks of places that were never pulled are dropped."""
    return acked_places(acks).join(shuffled(delivered), [*CONSUMER, "pull_seq"])


def records(pulls: DataFrame, acks: DataFrame) -> DataFrame:
    """Every pull and ack of a message: (subject, seq, group, consumer_id, pull_seq, action 0 pull or 1 ack, at)."""
    delivered = deliveries(pulls)
    columns = ["subject", "seq", "group", "consumer_id", "pull_seq"]
    pulled = delivered.select(*columns, F.lit(0).cast("long").alias("action"), F.col("pull_ts").alias("at"))
    acked = ack_records(acks, delivered).select(*columns, F.lit(1).cast("long").alias("action"), F.col("ack_ts").alias("at"))
    return pulled.unionByName(acked)


def lost_acks(acks: DataFrame) -> DataFrame:
    """(consumer, lo, hi) of pulled places that later acks jumped over."""
    return gaps(acks, CONSUMER, "first_pull", "last_pull")


def duplicate_acks(acks: DataFrame) -> DataFrame:
    """(consumer, duplicates): places acked more than once."""
    each = acked_places(acks).groupBy(*CONSUMER, "pull_seq").agg((F.count("*") - 1).alias("more"))
    return each.groupBy(*CONSUMER).agg(F.sum("more").alias("duplicates")).filter("duplicates > 0")


def sent_to_retry(acks: DataFrame, delivered: DataFrame) -> DataFrame:
    """Messages of lost acks, under the retry subject of their group."""
    missing = lost_acks(acks).withColumn("pull_seq", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    found = missing.join(shuffled(delivered), [*CONSUMER, "pull_seq"])
    return found.select(subjects.retry_subject(F.col("subject"), F.col("group")).alias("subject"), "consumer_id", "pull_seq", "seq")


def unacked_run(delivered: DataFrame, progress: DataFrame, readable: DataFrame) -> DataFrame:
    """(consumer, lo, hi, n, skipped): of what a consumer pulled and did not ack, the first run of readable messages.

    Unreadable messages before the run are skipped and count as acked; those behind a hole wait.
    """
    pending = shuffled(delivered).join(progress.select(*CONSUMER, "ack"), CONSUMER).filter(F.col("pull_seq") > F.col("ack"))
    good = ranges(pending.join(shuffled(readable), ["subject", "seq"], "left_semi"), CONSUMER, "pull_seq")
    first = good.groupBy(*CONSUMER).agg(F.min_by(F.struct("lo", "hi", "n"), "lo").alias("run"))
    return first.join(progress.select(*CONSUMER, "ack"), CONSUMER).select(*CONSUMER, "run.lo", "run.hi", "run.n", (F.col("run.lo") - F.col("ack") - 1).alias("skipped"))


def coalesced_acks(done: DataFrame, size: int) -> DataFrame:
    """Runs of handled messages cut into acks of at most `size`."""
    runs = ranges(done, CONSUMER, "pull_seq")
    pieces = runs.withColumn("first_pull", F.explode(F.sequence("lo", "hi", F.lit(size).cast("long"))))
    return pieces.select(*CONSUMER, "first_pull", F.least(F.col("first_pull") + size - 1, "hi").alias("last_pull"))


def compacted(delivered: DataFrame, progress: DataFrame) -> DataFrame:
    """Deliveries that are not acked yet; the rest of a pull log can go."""
    return delivered.join(progress.select(*CONSUMER, "ack"), CONSUMER, "left").filter(F.col("pull_seq") > F.coalesce("ack", F.lit(-1))).drop("ack")


def without_gone(delivered: DataFrame, gone: DataFrame) -> DataFrame:
    """Deliveries of consumers that have not left for good."""
    return delivered.join(gone, CONSUMER, "left_anti")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Idempotent consumption: of the rows with one key the first; found before rows are shuffled, too, so a hot key is no burden."""
    whole = F.struct(*(F.col(c) for c in [*order, *(c for c in df.columns if c not in order)]))
    first = df.groupBy(*key).agg(F.min(whole).alias("_first"))
    return first.select(*(F.col("_first")[c].alias(c) for c in df.columns))
