"""History tables: what is written, how it is sorted, and lookups in runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import attrs, keys, subjects
from tidelog.operators.delivery import unacked_run
from tidelog.operators.progress import CONSUMER, GROUP
from tidelog.operators.sequence import gaps, last_known, with_sequence


def record_rows(records: DataFrame, codes: DataFrame, broker_id: str, group_codes: DataFrame) -> DataFrame:
    """Pull and ack records under their row keys."""
    coded = keys.encoded(keys.encoded(records, codes, "subject", "_subject"), group_codes, "group", "_group")
    key = keys.record_key(F.col("_subject"), F.col("seq"), F.lit(broker_id), F.col("_group"), F.col("action").cast("string"))
    return coded.withColumn("row_key", key).drop("_subject", "_group")


def dead_record_time(time: Column) -> Column:
    """Half a second after the message, so that its death sorts behind what led to it."""
    return time + F.expr("INTERVAL '0.5' SECOND")


def index_rows(log: DataFrame, codes: DataFrame, broker_id: str, group_codes: DataFrame) -> DataFrame:
    """(row_key, value) of a log's messages: those of retry subjects under the retry key of the subject they came from."""
    named = log.withColumns({"_real": subjects.real_subject(F.col("subject")), "_of": subjects.group_of(F.col("subject")), "_again": subjects.is_retry(F.col("subject"))})
    coded = keys.encoded(keys.encoded(named, codes, "_real", "_subject"), group_codes, "_of", "_group")
    again = keys.retry_message_key(F.col("_subject"), F.col("create_time"), F.col("message_id"), F.lit(broker_id), F.coalesce("_group", F.lit("000000")), F.col("seq"))
    key = F.when(F.col("_again"), again).otherwise(keys.message_key(F.col("_subject"), F.col("create_time"), F.col("message_id")))
    return coded.select(key.alias("row_key"), packed(F.col("seq"), F.col("create_time"), F.lit("b1"), F.col("message_id")).alias("value"))


def dead_rows(dead: DataFrame, codes: DataFrame, group_codes: DataFrame) -> DataFrame:
    """(kind, row_key, value) of dead messages: `message` for the lists of a group, `record` for the trail of a message, `content` with its body."""
    named = dead.withColumns({"_real": subjects.real_subject(F.col("subject")), "_of": subjects.group_of(F.col("subject"))})
    coded = keys.encoded(keys.encoded(named, codes, "_real", "_subject"), group_codes, "_of", "_group")
    by_group = keys.dead_message_key(F.col("_subject"), F.col("_group"), F.col("create_time"), F.col("message_id"))
    by_message = keys.dead_record_key(F.col("_subject"), F.col("message_id"), F.col("_group"))
    record = F.concat_ws("|", "seq", F.unix_millis(dead_record_time(F.col("create_time")).cast("timestamp")), "_of")
    each = F.array(
        F.struct(F.lit("message").alias("kind"), by_group.alias("row_key"), packed(F.col("seq"), F.col("create_time"), F.lit("b1"), F.col("message_id")).alias("value")),
        F.struct(F.lit("record").alias("kind"), by_message.alias("row_key"), record.alias("value")),
        F.struct(F.lit("content").alias("kind"), by_group.alias("row_key"), F.col("body").alias("value")),
    )
    return coded.select(F.explode(each).alias("row")).select("row.*").filter("value IS NOT NULL")


def action_log(actions: DataFrame, keys_: list[str], order: str) -> DataFrame:
    """Pulls and acks appended to one log of actions: each gets the next place of its subject and group."""
    return with_sequence(actions, keys_, order, "place")


def put_in_pull_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """(consumer, pull_seq, seq, status) of entries to be written: what lies before a log's end is there already."""
    ends = log.groupBy(*CONSUMER).agg(F.max("pull_seq").alias("_end"))
    status = F.when(F.col("pull_seq") <= F.coalesce("_end", F.lit(-1)), "already written").otherwise("written")
    return new.join(ends, CONSUMER, "left").select(*CONSUMER, "pull_seq", "seq", status.alias("status"))


def with_holes(log: DataFrame) -> DataFrame:
    """A consumer's pull log without gaps: places that nothing was written to hold -1."""
    holes = gaps(log, CONSUMER, "pull_seq", "pull_seq").select(*CONSUMER, F.explode(F.sequence("lo", "hi")).alias("pull_seq"), F.lit(-1).cast("long").alias("seq"))
    return log.select(*CONSUMER, "pull_seq", "seq").unionByName(holes)


def outbox(inserted: DataFrame, sent: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """The outbox after its transactions: sent rows are gone, blocked ones have status -100, others wait (0)."""
    marked = blocked.select(key).distinct().withColumn("_blocked", F.lit(True))
    left = inserted.join(sent.select(key), key, "left_anti").join(marked, key, "left")
    return left.withColumn("status", F.when(F.col("_blocked"), -100).otherwise(0)).drop("_blocked")


def sorted_for_load(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ranges of the key and sorted inside them, ready to be written as sorted files."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def packed(seq: Column, time: Column, broker: Column, message_id: Column) -> Column:
    return F.concat_ws("|", seq.cast("string"), F.unix_micros(time.cast("timestamp")).cast("string"), broker, message_id)


def unpacked(value: Column, longest: int = 200) -> dict[str, Column]:
    """Fields of a packed value; one that is longer than allowed gives nulls."""
    parts = F.split(F.when(F.length(value) <= longest, value), r"\|", 4)
    return {"seq": parts[0].cast("long"), "micros": parts[1].cast("long"), "broker": parts[2], "message_id": parts[3]}


def packed_message(flag: Column, created: Column, due: Column, subject: Column, message_id: Column, tags: Column, attributes: Column) -> Column:
    """A whole message as one JSON text."""
    micros = [F.unix_micros(t.cast("timestamp")).alias(n) for t, n in ((created, "created"), (due, "due"))]
    return F.to_json(F.struct(flag.alias("flag"), *micros, subject.alias("subject"), message_id.alias("id"), tags.alias("tags"), attributes.alias("attrs")))


def unpacked_message(value: Column) -> dict[str, Column]:
    """Its typed fields. Without the tag flag there are no tags; attributes that cannot be read give the mark of corrupt ones."""
    m = F.from_json(value, "flag int, created bigint, due bigint, subject string, id string, tags array<string>, attrs string")
    times = {n: F.timestamp_micros(m[x]).cast("timestamp_ntz") for n, x in (("create_time", "created"), ("schedule_time", "due"))}
    tags = F.when(attrs.has_flag(m["flag"], attrs.TAGGED), m["tags"])
    return {"flag": m["flag"], **times, "subject": m["subject"], "message_id": m["id"], "tags": tags, "attrs": attrs.decoded(m["attrs"])}


def floor_lookup(wanted: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """Messages of pulled places by the last run of the consumer that begins at or before them (-1: none reaches so far).

    Places and runs are put into one order, and each place takes the last run before it.
    """
    places = wanted.select(*CONSUMER, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("struct<first_pull: bigint, last_pull: bigint, first_msg: bigint>").alias("_run"))
    begun = runs.select(*CONSUMER, F.col("first_pull").alias("_at"), F.lit(0).alias("_asks"), F.struct("first_pull", "last_pull", "first_msg").alias("_run"))
    found = last_known(places.unionByName(begun), CONSUMER, ["_at", "_asks"], "_run", "run").filter("_asks = 1")
    seq = F.when(F.col("_at") <= F.col("run.last_pull"), F.col("run.first_msg") + F.col("_at") - F.col("run.first_pull")).otherwise(-1)
    return found.select(*CONSUMER, F.col("_at").alias(at), seq.cast("long").alias("seq"))


def pull(progress: DataFrame, groups: DataFrame, delivered: DataFrame, readable: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(consumer, kind, lo, hi): what each consumer gets next.

    Messages it pulled and did not ack come first (`again`, places in its pulls), then new messages
    of the subject (`new`, sequences), at most so many; at the end of the subject it waits (`wait`).
    """
    again = unacked_run(delivered, progress, readable)
    fresh = groups.join(ends.select("subject", "max_seq"), "subject")
    lo, hi = F.col("max_pulled") + 1, F.least(F.col("max_pulled") + most, F.col("max_seq"))
    rows = progress.select(*CONSUMER).join(again.select(*CONSUMER, "lo", "hi"), CONSUMER, "left").join(fresh, GROUP)
    new = lo <= F.col("max_seq")
    kind = F.when(F.col("lo").isNotNull(), "again").when(new, "new").otherwise("wait")
    return rows.select(*CONSUMER, kind.alias("kind"), F.coalesce("lo", F.when(new, lo)).alias("lo"), F.coalesce(F.least(F.col("lo") + most - 1, "hi"), F.when(new, hi)).alias("hi"))


def replay_start(start: Column, low: Column, high: Column) -> Column:
    """Where a log is read again from: the checkpoint, inside what the log still has."""
    return F.when(start <= 0, low).when(start > high, high).otherwise(start)


def weights(outcomes: DataFrame, keys_: list[str], order: str, first: float = 100.0, segment: int = 1 << 12) -> DataFrame:
    """(keys, weight) of brokers after their pulls in order: `timeout` quarters, `none` halves, `less` and `more` change it by a quarter, `full` raises it by half; always 5 to 150.

    Any number of such steps scales a weight and then bounds it. Each segment of the order is folded to
    one scale and two bounds, and the segments of a key are folded again, so no row holds a whole history.
    """
    factor = F.when(F.col("outcome") == "timeout", 0.25).when(F.col("outcome") == "none", 0.5).when(F.col("outcome") == "less", 0.75).when(F.col("outcome") == "more", 1.25).otherwise(1.5)
    step = F.struct(F.col(order).alias("at"), F.lit(1.0).alias("begin"), factor.alias("scale"), F.lit(5.0).alias("low"), F.lit(150.0).alias("high"))
    folded = outcomes.select(*keys_, F.floor(F.col(order) / segment).alias("_segment"), step.alias("_step"))
    none = F.struct(F.lit(1.0).alias("scale"), F.lit(-float("inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def bounded(x: Column, y: Column) -> Column:
        return F.least(y["high"], F.greatest(y["low"], x * y["scale"]))

    def after(x: Column, y: Column) -> Column:
        return F.struct((x["scale"] * y["scale"]).alias("scale"), bounded(x["low"], y).alias("low"), bounded(x["high"], y).alias("high"))

    def steps(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.array_sort(F.collect_list("_step")).alias("_steps"))

    # a key's first segment is folded from its first weight itself, as one pull after the other
    begun = outcomes.groupBy(*keys_).agg(F.floor(F.min(order) / segment).alias("_first"))
    in_segments = steps(folded, [*keys_, "_segment"]).join(begun, keys_)
    weight = F.aggregate("_steps", F.lit(first), bounded)
    each = F.aggregate("_steps", none, after)
    one = F.when(F.col("_segment") == F.col("_first"), F.struct(weight.alias("scale"), weight.alias("low"), weight.alias("high"))).otherwise(each)
    halves = in_segments.select(*keys_, F.struct(F.col("_segment").alias("at"), one.alias("f")).alias("_step"))
    whole = halves.groupBy(*keys_).agg(F.array_sort(F.collect_list("_step")).alias("_steps"))
    return whole.select(*keys_, F.aggregate(F.slice("_steps", F.lit(2), F.greatest(F.size("_steps") - 1, F.lit(0))), F.element_at("_steps", 1)["f"]["low"], lambda x, y: bounded(x, y["f"])).alias("weight"))
