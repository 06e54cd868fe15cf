"""Shards by jump consistent hashing, and gapless places inside them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._text import mix

#: Parts of a shard that are numbered separately.
PARTS = 1024
#: Equal rows are numbered in runs of at most this many.
RUN = 1 << 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: a key jumps on to ever higher shards, and its last jump below `shards` counts.

    From shard b the next jump goes to floor((b + 1) * 2**31 / (r + 1)) for a 31-bit random r that the
    key's generator gives, so going from n to n + 1 shards moves a key with probability 1 / (n + 1),
    and only to the new shard.
    """
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        r = (state[moving] >> np.uint64(33)).astype(np.float64)
        there = ((at[moving] + 1) * (float(1 << 31) / (r + 1))).astype(np.int64)
        moving, there = moving[there < shards], there[there < shards]
        at[moving] = there
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a long key; null is a key of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series, missing: pd.Series) -> pd.Series:
        mixed = mix(keys.to_numpy(np.int64).view(np.uint64)) ^ np.where(missing.to_numpy(bool), np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        return pd.Series(jump(mixed, shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0)), key.isNull())


def assign_shards(df: DataFrame, shards: int, id_column: str = "doc_id") -> DataFrame:
    """The rows with `shard` and `grown_shard`, the shard with one shard more (columns of these names are replaced).

    The id and the number of shards alone decide. Equal ids, and all null ids, share a shard. An empty
    table gives an empty table.
    """
    key = F.col(id_column)
    return df.withColumn("shard", shard_of(key, shards)).withColumn("grown_shard", shard_of(key, shards + 1))


def numbered(df: DataFrame, shard: str = "shard", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with `slot`, which numbers those of each shard from 0 without gaps (a column of this name is replaced).

    Equal rows are counted first and numbered in runs, and a shard is numbered in parts by a hash of
    the row, so neither a large shard nor one row that occurs very often meets in a single task. The
    same rows give the same numbers in every run. `columns` are those that the order looks at (all).
    """
    df = df.drop("slot")
    names = [f"row.{x}" for x in columns or [x for x in df.columns if x != shard]]
    counted = df.select(F.struct("*").alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    counted = counted.select("row", "n", F.col(f"row.{shard}").alias("shard"), F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int").alias("part"))
    sums = counted.groupBy("shard", "part").agg(F.sum("n").alias("sum"))
    before = sums.select("shard", "part", (F.sum("sum").over(Window.partitionBy("shard").orderBy("part")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy(*names)
    first = counted.join(before, ["shard", "part"]).withColumn("first", F.col("before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    return runs.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, last))).select("row.*", (F.col("slot") + F.col("first")).alias("slot"))
