"""Log tables derived from the given tables by fixed rules, and reads of parts of a log.

A log's rows carry `offset`, the place in the one append-only log that all subjects share, and `seq`,
the gapless place in their subject.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.operators.sequence import read_prefix, with_sequence
from tidelog.stage import is_there, shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where an application has written the derived logs, by (application, folder, log).
_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], order: list[str]) -> DataFrame:
    """A derived log, written once for each application and folder of tables, sorted inside files.

    Reads push their filters on subject, sequence, offset or time down to its row groups. The tables
    are taken to stay as they are while the application runs.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED or not is_there(spark, _STORED[key][0]):
        df = make().sortWithinPartitions(*order)
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; the subject is the event type, the offset the event id."""

    def make() -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        rows = read(spark, sf_dir, "events").select(
            F.col("event_type").alias("subject"),
            F.col("event_id").alias("offset"),
            F.concat(F.lit("m"), F.col("event_id")).alias("message_id"),
            F.col("ts").alias("create_time"),
            "user_id",
            "value",
            k.alias("k"),
        )
        return with_sequence(rows, ["subject"], "offset")

    rows = stored(spark, sf_dir, "messages", make, ["subject", "seq"])
    rows = rows.withColumn("tags", F.array(F.concat(F.lit("k"), F.col("k") % 3), F.concat(F.lit("p"), F.col("k") % 5)))
    return rows.withColumn("times", (F.col("k") % 6 + 1).cast("long")).withColumn("max_retry", F.lit(3).cast("long"))


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull actions: two groups read each subject in blocks of 20, dealt to three consumers in turn."""

    def make() -> DataFrame:
        rows = messages(spark, sf_dir).groupBy("subject", F.floor(F.col("seq") / 20).alias("block"))
        blocks = rows.agg(F.min("seq").alias("first_msg"), F.max("seq").alias("last_msg"), F.max("create_time").alias("ts"))
        dealt = blocks.withColumn("group", F.explode(F.array(F.lit("g0"), F.lit("g1")))).withColumn("consumer_id", F.concat(F.lit("c"), F.col("block") % 3))
        # all blocks of a consumer before its last one are full
        return dealt.withColumn("first_pull", F.floor(F.col("block") / 3) * 20).withColumn("last_pull", F.col("first_pull") + F.col("last_msg") - F.col("first_msg"))

    return stored(spark, sf_dir, "pulls", make, ["subject", "group", "consumer_id", "first_pull"])


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ack actions: each pulled range but every seventh block; every eleventh block is acked twice."""
    kept = pulls(spark, sf_dir).filter("block % 7 <> 3")
    twice = F.explode(F.sequence(F.lit(0), F.when(F.col("block") % 11 == 5, 1).otherwise(0)))
    return kept.withColumn("again", twice).select("subject", "group", "consumer_id", "block", "ts", "first_pull", "last_pull", F.col("again").cast("long").alias("again"))


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed messages from orders; the schedule time is up to three days after the order."""
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("seq"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_orderdate").alias("create_time"),
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 72 AS int), 0, 0)").alias("schedule_time"),
    )


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed(spark, sf_dir).filter("(seq - 1) % 4 <> 0")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client instances from customers."""
    kinds = F.array(*map(F.lit, SUBJECTS))
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("client_id"),
        F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int")).alias("subject"),
        F.concat(F.lit("g"), F.col("c_custkey") % 2).alias("group"),
        F.col("c_mktsegment").alias("app_code"),
        F.concat(F.lit("room"), F.col("c_nationkey") % 3).alias("room"),
        F.when(F.col("c_custkey") % 4 == 0, "producer").otherwise("consumer").alias("client_type"),
        F.col("c_custkey").alias("client_key"),
    )


#: The event types of the test tables, in order.
SUBJECTS = ("click", "error", "purchase", "signup", "view")


def broker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker groups from nations: every ninth neither reads nor writes (4), every fifth only reads (3)."""
    key = F.col("n_nationkey")
    state = F.when(key % 9 == 0, 4).when(key % 5 == 1, 3).otherwise(1)
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("group_name"), F.when(key % 6 == 5, "delay").otherwise("real").alias("kind"), F.concat(F.lit("tag"), F.col("n_regionkey")).alias("tag"), state.cast("long").alias("broker_state"), key.cast("long").alias("group_key"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, broker_groups) with a JSON list of group names, of which some do not exist."""
    rows = [(s, f'["NATION_{3 * i}", "NATION_{3 * i + 1}", "NATION_{40 + i}"]') for i, s in enumerate(SUBJECTS)]
    return spark.createDataFrame(rows, "subject string, broker_groups string")


def scan_from(log: DataFrame, start: int) -> DataFrame:
    """Rows from an offset on; a start before the log's first row reads from there, as nothing lies before it."""
    return log.filter(F.col("offset") >= start)


def scan_between(log: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of offsets start to end, the end excluded."""
    return log.filter((F.col("offset") >= start) & (F.col("offset") < end))


def cursor(log: DataFrame, start: int, most: int, size: Column) -> DataFrame:
    """Up to so many rows from a start that is moved into the log's bounds, with `visited`, the size read so far."""
    low = log.agg(F.min("offset")).scalar()
    return read_prefix(log.filter(F.col("offset") >= F.greatest(F.lit(start), low)).withColumn("_size", size), ["offset"], most, "_size", 1 << 62, "visited").drop("_size")


def valid_index(index: DataFrame) -> DataFrame:
    """Index records that can be read: a sequence of 0 or more, a time, a subject and an id."""
    return index.filter((F.col("seq") >= 0) & F.col("create_time").isNotNull() & (F.col("subject") != "") & (F.col("message_id") != ""))


def point(log: DataFrame, subject: str, seq: int) -> DataFrame:
    return log.filter((F.col("subject") == subject) & (F.col("seq") == seq))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the wanted (subject, seq); keys that the log lacks are skipped."""
    return log.join(keys.distinct(), ["subject", "seq"], "left_semi")


def received_json(rows: DataFrame, column: str) -> DataFrame:
    """Adds `attrs`, the fields of a JSON object as text; numbers keep their digits (not an object: null)."""
    return rows.withColumn("attrs", F.from_json(F.col(column), "map<string,string>"))


def typed_properties(rows: DataFrame, column: str) -> DataFrame:
    """A row for each property of the rows' JSON objects: `key`, `kind` and its `text`.

    Whole numbers are `integer`, or `long` where they are too large for one, other numbers `double`;
    there are `boolean`s, `string`s and `null`s, and all else is `other`, kept as JSON.
    """
    value = rows.withColumn("_v", F.try_parse_json(F.col(column)))
    each = value.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind, number = F.schema_of_variant("value"), F.try_variant_get("value", "$", "long")
    named = (
        F.when(F.is_variant_null("value"), "null")
        .when(kind == "BIGINT", F.when(number.between(-(1 << 31), (1 << 31) - 1), "integer").otherwise("long"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "double")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .otherwise("other")
    )
    return each.withColumns({"kind": named, "text": F.try_variant_get("value", "$", "string")}).drop("_v", "pos", "value")
