"""Predicates on messages, and chains of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import attrs, subjects
from tidelog.operators.sequence import ranges


@dataclass(frozen=True)
class MessageFilter:
    """A predicate, and whether the request asks for it at all; one that is not asked for keeps everything."""

    active: bool
    match: Column


def tag_filter(kind: str, wanted: list[str], tags: Column) -> MessageFilter:
    """`OR`: any wanted tag; `AND`: all of them; `NO_TAG` or nothing wanted: not active. No tags: no match."""
    if kind == "NO_TAG" or not wanted:
        return MessageFilter(False, F.lit(True))
    asked = F.array(*map(F.lit, wanted))
    found = F.arrays_overlap(tags, asked) if kind == "OR" else F.size(F.array_except(asked, tags)) == 0
    return MessageFilter(True, F.coalesce(found & (F.size(tags) > 0), F.lit(False)))


def env_filter(rule_env: str | None, rule_sub_env: str | None, env: Column, sub_env: Column) -> MessageFilter:
    """The message's environment must be that of the rule found for the group; without one nothing passes."""
    if not rule_env or rule_sub_env is None:
        return MessageFilter(True, F.lit(False))
    return MessageFilter(True, F.coalesce((env == rule_env) & (sub_env == rule_sub_env), F.lit(False)))


def keep(df: DataFrame, filters: list[MessageFilter]) -> DataFrame:
    for f in filters:
        if f.active:
            df = df.filter(f.match)
    return df


def by_env_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages of a group's isolated environment: `rules` give (subject, group, env, sub_env), a small table.

    Rows of (subject, group) without a rule, or whose rule lacks an environment, are dropped.
    """
    usable = rules.filter("env IS NOT NULL AND env <> '' AND sub_env IS NOT NULL")
    return df.join(usable, ["subject", "group", "env", "sub_env"], "left_semi")


def kept_ranges(df: DataFrame, filters: list[MessageFilter], keys: list[str], value: str = "seq") -> DataFrame:
    """The runs of neighbouring rows that pass, and for each key an empty run (n = 0) at the end of the rows seen."""
    found = ranges(keep(df, filters), keys, value)
    end = df.groupBy(*keys).agg(F.max(value).alias("lo")).select(*keys, "lo", F.col("lo").alias("hi"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(end)


def ready_prefix(df: DataFrame, keys: list[str], order: str, ready: Column) -> DataFrame:
    """The rows of each key before the first one that is not ready."""
    first = df.withColumn("_ready", ready).groupBy(*keys).agg(F.min(F.when(~F.col("_ready"), F.col(order))).alias("_stop"))
    return df.join(first, keys).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def retry_ready(time: Column, now: Column, seconds: int = 5) -> Column:
    """Whether a retry message has waited long enough to be seen."""
    return time + F.make_dt_interval(secs=F.lit(seconds)) <= now


def hooked(df: DataFrame, hooks: list[tuple[str, Column]]) -> DataFrame:
    """The rows with `handled` and `ran`, the hooks in the order they ran.

    Hooks run before a message in order, up to the first that refuses it; after it those that ran run
    again, last one first. A message is handled if none refuses it.
    """
    refused = F.coalesce(*(F.when(~F.coalesce(passes, F.lit(False)), F.lit(i + 1)) for i, (_, passes) in enumerate(hooks)))
    names = F.slice(F.array(*(F.lit(name) for name, _ in hooks)), F.lit(1), F.coalesce(refused, F.lit(len(hooks))))
    before, after = F.transform(names, lambda x: F.concat(F.lit("pre "), x)), F.transform(F.reverse(names), lambda x: F.concat(F.lit("post "), x))
    return df.withColumns({"handled": refused.isNull(), "ran": F.concat(before, after)})


def for_protocol(df: DataFrame, version: str, least: int = 8) -> DataFrame:
    """Messages as clients of a protocol version read them: old ones know no tags."""
    old = F.col(version) < least
    return df.withColumns({"tags": F.when(~old, F.col("tags")), "flag": F.when(old, F.col("flag").bitwiseAND(F.lit(~attrs.TAGGED))).otherwise(F.col("flag"))})


def consumer_outcome(df: DataFrame, at_most_once: bool, group: str) -> DataFrame:
    """The rows with `outcome`: `delivered`, or why the client acks them unread."""
    outcome = (
        F.when(F.col("corrupt"), "corrupt")
        .when(F.lit(at_most_once) & (F.col("times") > 1), "redelivered")
        .when(F.col("bound_group").isNotNull() & (F.col("bound_group") != group), "other_group")
        .otherwise("delivered")
    )
    return df.withColumn("outcome", outcome)


def validated(df: DataFrame, reject_illegal: bool = True) -> DataFrame:
    """The rows with `verdict`: `ok`, `empty` (no id or subject), `illegal` (subject), and the subject repaired where not rejected."""
    empty = F.coalesce(F.col("message_id"), F.lit("")) == ""
    bare = F.coalesce(F.col("subject"), F.lit("")) == ""
    illegal = subjects.is_invalid(F.col("subject"))
    verdict = F.when(empty | bare, "empty").when(illegal & F.lit(reject_illegal), "illegal").otherwise("ok")
    judged = df.withColumn("verdict", verdict)
    return judged if reject_illegal else judged.withColumn("subject", F.regexp_replace("subject", r"[/\s]", ""))


def without(df: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows whose subject is not in the list of skipped ones and no dead one."""
    return df.filter(~subjects.is_dead(F.col("subject"))).join(skipped, "subject", "left_anti")


def to_compensate(outbox: DataFrame, now: Column, age: int = 60, most: int = 50, most_errors: int = 1000) -> DataFrame:
    """The oldest unsent rows of an outbox with `action`: `send`, or why they are skipped."""
    due = outbox.filter((F.col("status") == 0) & (F.col("update_time") < now - F.make_dt_interval(secs=F.lit(age)))).orderBy("id").limit(most)
    subject = F.get_json_object("content", "$.subject")
    action = (
        F.when(F.col("error") >= most_errors, "too many errors")
        .when(F.coalesce("content", F.lit("")) == "", "empty")
        .when(subject.isNull() | (F.trim(subject) == ""), "no subject")
        .when(F.contains(subject, F.lit("${")), "placeholder")
        .otherwise("send")
    )
    return due.withColumn("action", action)
