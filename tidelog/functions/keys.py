"""Row keys of history tables, dictionary codes, and fields of packed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.sequence import with_sequence


def inverted_date(time: Column) -> Column:
    """Twelve places that sort later times first, to the second."""
    return F.lpad((F.lit(999_999_999_999) - F.date_format(time, "yyMMddHHmmss").cast("long")).cast("string"), 12, " ")


def digest(text: Column) -> Column:
    return F.md5(text)


def short_digest(text: Column) -> Column:
    """The sixteen places in the middle of the digest."""
    return F.substring(F.md5(text), 9, 16)


def padded(seq: Column) -> Column:
    return F.lpad(seq.cast("string"), 19, "0")


def message_key(subject_id: Column, time: Column, message_id: Column) -> Column:
    return F.concat(subject_id, inverted_date(time), digest(message_id))


def retry_message_key(subject_id: Column, time: Column, message_id: Column, broker_id: Column, group_id: Column, seq: Column) -> Column:
    return F.concat(subject_id, digest(message_id), inverted_date(time), broker_id, group_id, padded(seq))


def dead_message_key(subject_id: Column, group_id: Column, time: Column, message_id: Column) -> Column:
    return F.concat(subject_id, group_id, inverted_date(time), digest(message_id))


def dead_record_key(subject_id: Column, message_id: Column, group_id: Column) -> Column:
    return F.concat(subject_id, digest(message_id), group_id)


def record_key(subject_id: Column, seq: Column, broker_id: Column, group_id: Column, action: Column) -> Column:
    return F.concat(subject_id, padded(seq), broker_id, group_id, action)


def record_fields(key: Column) -> dict[str, Column]:
    """Sequence and action read back from a record key."""
    return {"seq": F.substring(key, 7, 19).cast("long"), "action": F.substring(key, -1, 1)}


def _of(value: str | None, otherwise: str) -> str:
    return value or otherwise


# Lengths of codes, dates, digests and sequences in row keys.
_CODE, _DATE, _DIGEST, _SEQ = r"\d{6}", r"[ \d]{12}", r"\w{32}", r"\d{19}"


def message_pattern(subject_id: str, digest_: str | None = None) -> str:
    """Keys of a subject's messages, or of one message."""
    return f"^{subject_id}{_DATE}{_of(digest_, _DIGEST)}$"


def retry_message_pattern(subject_id: str, digest_: str) -> str:
    return f"^{subject_id}{digest_}{_DATE}{_CODE}{_CODE}{_SEQ}$"


def dead_message_pattern(subject_id: str, group_id: str | None = None, digest_: str | None = None) -> str:
    """Keys of a subject's dead messages, of all groups or one, of all messages or one."""
    return f"^{subject_id}{_of(group_id, _CODE)}{_DATE}{_of(digest_, _DIGEST)}$"


def dead_record_pattern(subject_id: str, digest_: str) -> str:
    return f"^{subject_id}{digest_}{_CODE}$"


def record_pattern(subject_id: str, seq: int, broker_id: str) -> str:
    return f"^{subject_id}{seq:019d}{broker_id}{_CODE}\\d$"


def dictionary(names: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(name, code): six digits or more for each distinct name.

    Names of a known dictionary keep their codes, so that stored keys stay right; new ones get the next
    codes in order of names. Names are numbered in segments of equal first bytes.
    """
    distinct = names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct()
    if known is not None:
        distinct = distinct.join(known.select("name"), "name", "left_anti")
    begins = F.conv(F.rpad(F.hex(F.substring(F.encode("name", "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("long")
    numbered = with_sequence(distinct, [], "name", "_place", 1, begins)
    if known is None:
        return numbered.select("name", _six(F.col("_place")).alias("code"))
    last = known.agg(F.coalesce(F.max(F.col("code").cast("long")), F.lit(0))).scalar()
    return known.select("name", "code").unionByName(numbered.select("name", _six(F.col("_place") + last).alias("code")))


def _six(number: Column) -> Column:
    digits = number.cast("string")
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def encoded(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(codes.select(F.col("name").alias(column), F.col("code").alias(name)), column, "left")
