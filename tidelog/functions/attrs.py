"""Attributes, flags and times of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_attributes(fields: dict[str, Column]) -> Column:
    """A map of texts; fields that are null are left out."""
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))


def text(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def number(attrs: Column, key: str, kind: str = "long") -> Column:
    """The attribute as a number; a missing one is 0, one that is no number fails the query."""
    return F.coalesce(text(attrs, key).cast(kind), F.lit(0).cast(kind))


def truth(attrs: Column, key: str) -> Column:
    return F.coalesce(F.lower(text(attrs, key)) == "true", F.lit(False))


def moment(attrs: Column, key: str) -> Column:
    """The attribute, milliseconds of the epoch, as a time; a missing one is null, one that is no number fails the query."""
    return F.timestamp_millis(text(attrs, key).cast("long")).cast("timestamp_ntz")


#: Fixed value: the attribute that marks a message whose attributes cannot be read.
CORRUPT = "corruptData"


def decoded(text_: Column) -> Column:
    """Attributes from a JSON text; where that is broken, only the mark of corrupt data."""
    read = F.from_json(text_, "map<string,string>")
    return F.when(read.isNull() & text_.isNotNull(), F.create_map(F.lit(CORRUPT), F.lit("true"))).otherwise(read)


def parts(value: Column, size: int) -> Column:
    """A long text as pieces of `size` characters; a text within the size is one piece."""
    count = F.greatest(F.ceil(F.length(value) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(value, i * size + 1, F.lit(size)))


def joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


# The bits of a message's flags.
NOT_RELIABLE, DELAY, TAGGED = 1, 2, 4


def flags(reliable: Column, delay: Column, tagged: Column) -> Column:
    return F.when(reliable, 0).otherwise(NOT_RELIABLE) + F.when(delay, DELAY).otherwise(0) + F.when(tagged, TAGGED).otherwise(0)


def has_flag(flag: Column, bit: int) -> Column:
    """Whether a bit is set; reliability is the bit that is not."""
    return (flag.bitwiseAND(F.lit(bit)) == 0) if bit == NOT_RELIABLE else (flag.bitwiseAND(F.lit(bit)) != 0)


def bucket(time: Column, minutes: int = 60) -> Column:
    """Number yyyyMMddHHmm of the start of the time's bucket."""
    start = F.date_trunc("hour", time) + F.make_dt_interval(mins=F.floor(F.minute(time) / minutes).cast("int") * minutes)
    return F.date_format(start, "yyyyMMddHHmm").cast("long")


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def is_delayed(schedule: Column, now: Column, least: int = 500) -> Column:
    return millis(schedule) - millis(now) >= least


def clamped(schedule: Column, now: Column, days: int = 730) -> Column:
    """A schedule time not before now and at most two years ahead."""
    return F.greatest(F.least(schedule, now + F.make_dt_interval(days=F.lit(days))), now)


def search_window(begin: Column, end: Column, now: Column, days: int = 30) -> tuple[Column, Column]:
    """Begin and end of a search; by default the last thirty days."""
    last = F.coalesce(end, now)
    return F.coalesce(begin, last - F.make_dt_interval(days=F.lit(days))), last
