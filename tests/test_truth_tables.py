"""Fixed cases for predicates and names."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import attrs, keys, subjects
from tidelog.operators import filters, progress, sequence


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("subject, real, pair, kinds", [
    (None, None, None, (False, False, False)),
    ("%RETRY", "%RETRY", None, (False, True, False)),
    ("%DEAD_RETRY", "%DEAD_RETRY", None, (False, False, True)),
    ("%DEAD_RETRY%foo%bar", "foo", ["foo", "bar"], (False, False, True)),
    ("%RETRY%foo%bar", "foo", ["foo", "bar"], (False, True, False)),
    ("foo", "foo", None, (True, False, False)),
])
def test_subjects(spark, subject, real, pair, kinds):
    x = F.col("x")
    row = spark.createDataFrame([(subject,)], "x string").select(subjects.real_subject(x), subjects.subject_and_group(x), subjects.is_real(x), subjects.is_retry(x), subjects.is_dead(x)).first()
    assert (row[0], row[1], tuple(row)[2:]) == (real, pair, kinds)


@pytest.mark.parametrize("kind, wanted, tags, kept", [
    ("NO_TAG", ["tag1"], ["tag2"], True),
    ("OR", [], ["tag2"], True),
    ("OR", ["tag1", "tag2"], ["tag1"], True),
    ("AND", ["tag1", "tag2"], ["tag1", "tag2", "tag3"], True),
    ("AND", ["tag1", "tag2", "tag3"], ["tag1", "tag2"], False),
    ("OR", ["tag1"], [], False),
    ("AND", ["tag1"], [], False),
    ("OR", ["tag1"], None, False),
    ("AND", ["tag1"], ["tag1"], True),
    ("AND", ["tag1", "tag2"], ["tag1"], False),
])
def test_tag_filter(spark, kind, wanted, tags, kept):
    df = spark.createDataFrame([(tags,)], "tags array<string>")
    assert bool(filters.keep(df, [filters.tag_filter(kind, wanted, F.col("tags"))]).count()) is kept


@pytest.mark.parametrize("chain, kept", [
    ([(False, False)], True), ([(True, False)], False), ([(True, True)], True), ([(True, True), (True, False)], False), ([(True, True), (True, True)], True), ([(False, False), (False, False)], True),
])
def test_filter_chain(spark, chain, kept):
    found = filters.keep(spark.range(1), [filters.MessageFilter(active, F.lit(match)) for active, match in chain])
    assert bool(found.count()) is kept


@pytest.mark.parametrize("rule, message, kept", [(("test", "s"), ("test", "s"), True), (("test", "s"), ("test", "t"), False), ((None, "s"), ("test", "s"), False), (("", "s"), ("", "s"), False), (("test", None), ("test", None), False)])
def test_env_filter(spark, rule, message, kept):
    df = spark.createDataFrame([message], "env string, sub_env string")
    assert bool(filters.keep(df, [filters.env_filter(*rule, F.col("env"), F.col("sub_env"))]).count()) is kept


def test_missing_attributes_are_zero_and_bad_ones_fail(spark):
    df = spark.createDataFrame([({"n": "7", "bad": "x"},)], "a map<string,string>")
    a = F.col("a")
    assert tuple(df.select(attrs.number(a, "n"), attrs.number(a, "none"), attrs.truth(a, "none"), attrs.text(a, "none")).first()) == (7, 0, False, None)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(attrs.number(a, "bad")).collect()


def test_dates_sort_newest_first(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-02 03:04:05' AS t UNION ALL SELECT timestamp_ntz '2023-12-31 23:59:59'")
    assert [r.t.year for r in df.orderBy(keys.inverted_date(F.col("t"))).collect()] == [2024, 2023]
    assert one(spark, keys.padded(F.lit(42))) == "0" * 17 + "42"


def test_sequence_over_segments(spark):
    df = spark.createDataFrame([(s, o) for o, s in enumerate("abbaacab" * 5)], "subject string, offset long").repartition(5)
    rows = sequence.with_sequence(df, ["subject"], "offset", segment=7).orderBy("offset").collect()
    seen = {}
    for r in rows:
        assert r.seq == seen.get(r.subject, 0)
        seen[r.subject] = r.seq + 1


def test_gaps_and_ranges(spark):
    df = spark.createDataFrame([("a", 3, 5), ("a", 4, 9), ("a", 12, 12), ("b", 0, 2)], "k string, lo long, hi long")
    assert sorted(map(tuple, sequence.gaps(df, ["k"], "lo", "hi").collect())) == [("a", 0, 2), ("a", 10, 11)]
    assert sorted(map(tuple, sequence.merged_ranges(df, ["k"], "lo", "hi").collect())) == [("a", 3, 9), ("a", 12, 12), ("b", 0, 2)]
    values = spark.createDataFrame([("a", x) for x in (1, 2, 2, 4)], "k string, v long")
    assert sorted(map(tuple, sequence.ranges(values, ["k"], "v").collect())) == [("a", 1, 2, 2), ("a", 4, 4, 1)]


def test_read_positions(spark):
    strict = progress.read_position(F.lit(2), F.lit(5), F.lit(9), strict=True)
    assert tuple(spark.range(1).select(*strict).first()) == (2, "too small")
