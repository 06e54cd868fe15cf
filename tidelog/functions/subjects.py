"""Subjects, groups and composed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the subjects of messages to be consumed again, and of those given up.
RETRY = "%RETRY"
DEAD = "%DEAD_RETRY"


def retry_subject(subject: Column, group: Column) -> Column:
    return F.concat_ws("%", F.lit(RETRY), subject, group)


def dead_subject(subject: Column, group: Column) -> Column:
    return F.concat_ws("%", F.lit(DEAD), subject, group)


def is_retry(subject: Column) -> Column:
    return F.coalesce(F.startswith(subject, F.lit(RETRY)), F.lit(False))


def is_dead(subject: Column) -> Column:
    return F.coalesce(F.startswith(subject, F.lit(DEAD)), F.lit(False))


def is_real(subject: Column) -> Column:
    return subject.isNotNull() & ~is_retry(subject) & ~is_dead(subject)


def _parts(subject: Column) -> Column:
    return F.filter(F.transform(F.split(subject, "%"), F.trim), lambda x: x != "")


def _derived(subject: Column) -> Column:
    return (is_retry(subject) | is_dead(subject)) & (F.size(_parts(subject)) == 3)


def real_subject(subject: Column) -> Column:
    """The subject that a retry or dead one was made for; others stay as they are."""
    return F.when(_derived(subject), F.element_at(_parts(subject), 2)).otherwise(subject)


def group_of(subject: Column) -> Column:
    """The group of a retry or dead subject, else an empty text."""
    return F.when(_derived(subject), F.element_at(_parts(subject), 3)).otherwise("")


def subject_and_group(subject: Column) -> Column:
    """[subject, group] of a retry or dead subject, else null."""
    return F.when(_derived(subject), F.slice(_parts(subject), 2, 2))


def is_invalid(subject: Column) -> Column:
    """Null, empty, or with white space or a slash inside."""
    return subject.isNull() | (subject == "") | F.rlike(subject, F.lit(r"[/\s]"))


def is_valid_pull(subject: Column, group: Column, consumer: Column, most: Column) -> Column:
    """A pull needs three names without slashes or line breaks, and a positive number."""
    named = [x.isNotNull() & (x != "") & ~F.rlike(x, F.lit(r"[/\r\n]")) for x in (subject, group, consumer)]
    return F.coalesce(named[0] & named[1] & named[2] & (most > 0), F.lit(False))


def pull_size(most: Column, limit: int = 10_000) -> Column:
    return F.least(most, F.lit(limit))


def consumer_key(consumer: Column, group: Column, subject: Column) -> Column:
    return F.concat_ws("@", consumer, group, subject)


def split_key(key: Column) -> Column:
    return F.split(key, "@")


def message_id(time: Column, host: Column, process: Column, count: Column) -> Column:
    """An id whose parts are the time to the millisecond, the host, the process and a counter."""
    return F.concat_ws(".", F.date_format(time, "yyMMdd"), F.date_format(time, "HHmmssSSS"), host, process.cast("string"), count.cast("string"))


def idempotency_key(subject: Column, group: Column, key: Column) -> Column:
    return F.concat_ws("%", subject, group, key)


def endpoint(client: Column, room: Column, app: Column) -> Column:
    return F.concat(F.lit("tide://"), client, F.lit("?room="), room, F.lit("&appCode="), app)


def isolated_group(group: Column, env: Column, sub_env: Column) -> Column:
    return F.concat_ws("_", group, env, sub_env)


def text_or_empty(value: Column) -> Column:
    """Bytes as UTF-8 text, null as empty."""
    return F.coalesce(F.decode(value, "UTF-8"), F.lit(""))
