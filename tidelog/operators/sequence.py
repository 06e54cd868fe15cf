"""Sequences, runs of neighbours, and reads in order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of a segment; a subject is numbered segment by segment.
SEGMENT = 1 << 20


def with_carried(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the other columns of `small`, one row per keys; null keys meet null keys."""
    right = small.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    same = [df[k].eqNullSafe(right[f"_r{i}"]) for i, k in enumerate(keys)]
    return df.join(right, reduce(and_, same)).drop(*(f"_r{i}" for i in range(len(keys))))


def _running(df: DataFrame, keys: list[str], order: list[str], name: str, inner: Column, frame: tuple[int, int], total: Column, carry: Callable[[Column], Column], both: Callable, segment: Column) -> DataFrame:
    """Adds a running aggregate over the rows of equal keys, in order, by segments of them.

    `inner` runs over `frame` inside a segment; `total` is a segment's own value, `carry` runs over the
    totals of the segments before, and `both` puts the two together. Only the one row of each segment
    meets the others of its key in one task.
    """
    cut = df.withColumn("_segment", segment)
    per_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_segment").agg(total.alias("_total")).withColumn("_carry", carry(F.col("_total")).over(per_key)).drop("_total")
    inside = inner.over(Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(*frame))
    numbered = cut.withColumn("_inside", inside)
    return with_carried(numbered, before, [*keys, "_segment"]).withColumn(name, both(F.col("_carry"), F.col("_inside"))).drop("_segment", "_carry", "_inside")


_BEFORE, _UPTO = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def _cut(column: str, segment: int) -> Column:
    return F.floor(F.col(column) / segment)


def with_sequence(df: DataFrame, keys: list[str], offset: str, name: str = "seq", first: int = 0, segment: int | Column = SEGMENT) -> DataFrame:
    """The rows with their gapless place among those of equal keys (null ones too), in order of offset.

    Rows are numbered inside segments of offsets, and a segment starts after the rows of those before
    it, so a subject that holds most of the log is numbered by many tasks. Segments are so many offsets
    long, or given by a column that does not fall as the offset rises.
    """
    by = _cut(offset, segment) if isinstance(segment, int) else segment
    return _running(df, keys, [offset], name, F.count(F.lit(1)), _UPTO, F.count(F.lit(1)), F.sum, lambda carry, inside: F.coalesce(carry, F.lit(0)) + inside - 1 + first, by)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, segment: int = SEGMENT) -> DataFrame:
    """Adds `name`, the greatest value of the rows before (null: none), in the order of columns of which the first is a number."""
    return _running(df, keys, order, name, F.max(value), _BEFORE, F.max(value), F.max, F.greatest, _cut(order[0], segment))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, segment: int = SEGMENT) -> DataFrame:
    """Adds `name`, the sum of the values up to this row, in the order of columns of which the first is a number."""
    return _running(df, keys, order, name, F.sum(value), _UPTO, F.sum(value), F.sum, lambda carry, inside: F.coalesce(carry, F.lit(0)) + inside, _cut(order[0], segment))


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, segment: int = SEGMENT) -> DataFrame:
    """Adds `name`, the last value that is not null up to this row, in the order of columns of which the first is a number."""
    return _running(df, keys, order, name, F.last(value, ignorenulls=True), _UPTO, F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))), lambda x: F.last(x, ignorenulls=True), lambda carry, inside: F.coalesce(inside, carry), _cut(order[0], segment))


def ranges(df: DataFrame, keys: list[str], value: str, segment: int = SEGMENT) -> DataFrame:
    """(keys, lo, hi, n) of the maximal runs of consecutive values; repeated values count once.

    Runs are found inside segments of values; only those that touch the edge of a segment, two of each
    at most, meet in one task for a key.
    """
    rows = df.select(*keys, value).distinct().withColumn("_segment", _cut(value, segment))
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys, "_segment").orderBy(value))
    runs = rows.withColumn("_island", island).groupBy(*keys, "_segment", "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    at_edge = (F.pmod("lo", F.lit(segment)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(segment)) == 0)
    inner = runs.filter(~at_edge).select(*keys, "lo", "hi", "n")
    order = Window.partitionBy(*keys).orderBy("lo")
    edge = runs.filter(at_edge).withColumn("_new", F.when(F.lag("hi").over(order) + 1 == F.col("lo"), 0).otherwise(1))
    joined = edge.withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return inner.unionByName(joined.select(*keys, "lo", "hi", "n"))


def merged_ranges(df: DataFrame, keys: list[str], lo: str, hi: str, segment: int = SEGMENT) -> DataFrame:
    """(keys, lo, hi) of ranges joined where one begins no later than right after those before it end."""
    upto = running_max(df.select(*keys, lo, hi), keys, [lo, hi], hi, "_upto", segment)
    marked = upto.withColumn("_new", F.when(F.col(lo) <= F.col("_upto") + 1, 0).otherwise(1))
    numbered = running_sum(marked, keys, [lo, hi], "_new", "_run", segment)
    return numbered.groupBy(*keys, "_run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_run")


def gaps(df: DataFrame, keys: list[str], lo: str, hi: str, first: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(keys, lo, hi) of the values from `first` on that no range covers before the last one ends."""
    upto = running_max(df.select(*keys, lo, hi), keys, [lo, hi], hi, "_upto", segment)
    start = F.greatest(F.col("_upto"), F.lit(first - 1)) + 1
    return upto.filter(start < F.col(lo)).select(*keys, start.alias("lo"), (F.col(lo) - 1).alias("hi"))


def read_prefix(df: DataFrame, order: list[Column | str], most: int, size: str | None = None, most_size: int | None = None, name: str = "_upto") -> DataFrame:
    """The first `most` rows in order, as long as their sizes add up to no more than `most_size` (sums as `name`, if given)."""
    first = df.orderBy(*order).limit(most)
    if size is None:
        return first
    upto = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn(name, upto).filter(F.col(name) <= most_size).drop("_upto")


def page(df: DataFrame, key: str, size: int, after: str | None = None) -> DataFrame:
    """One page by ascending unique key, with `next_key` of the first row of the next page (null: none left)."""
    rows = df if after is None else df.filter(F.col(key) >= after)
    more = rows.orderBy(key).limit(size + 1).withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)))
    following = F.max(F.when(F.col("_place") == size + 1, F.col(key))).over(Window.partitionBy(F.lit(0)))
    return more.withColumn("next_key", following).filter(F.col("_place") <= size).drop("_place")


def as_one_result(parts: DataFrame, keys: list[str], lo: str, n: str) -> DataFrame:
    """Ranges read for one request as one result: `part` counts them in order, `upto` their messages, `start` is where the first begins."""
    numbered = running_sum(with_sequence(parts, keys, lo, "part"), keys, [lo], n, "upto")
    return with_carried(numbered, parts.groupBy(*keys).agg(F.min(lo).alias("start")), keys)


def latest_of_batch(df: DataFrame, batch: list[str], offset: str, value: str) -> DataFrame:
    """(batch, value of the row with the greatest offset)."""
    return df.groupBy(*batch).agg(F.max_by(value, offset).alias(value), F.max(offset).alias(offset))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """The rows with `batch`, counting up every `size` places of the gapless sequence `order`."""
    return df.withColumn("batch", F.floor(F.col(order) / size))
