"""Counters, meters, timers and gauges as aggregates."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidelog.operators.sequence import with_carried


def counter(df: DataFrame, tags: list[str], amount: Column | None = None) -> DataFrame:
    return df.groupBy(*tags).agg((F.count("*") if amount is None else F.sum(amount)).alias("total"))


def meter(df: DataFrame, tags: list[str], time: str, amount: Column) -> DataFrame:
    """(tags, minute, marks, amount) by minute."""
    return df.groupBy(*tags, F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("marks"), F.sum(amount).alias("amount"))


def quantiles(df: DataFrame, tags: list[str], value: str, shares: dict[str, str]) -> DataFrame:
    """(tags, n, a column for each named share): the least value that at least this share of the values does not exceed; exact. It takes one tag or more.

    A sketch gives two cuts about each share. Values between cuts are counted, and only those of the
    parts that hold a wanted place are put in order, so a tag with most of the rows is no burden. The
    cuts decide how many values are sorted, not what is found.
    """
    near = [min(max(float(s) + side, 0.0), 1.0) for s in shares.values() for side in (-0.0005, 0.0005)]
    cuts = df.groupBy(*tags).agg(F.count(value).alias("n"), F.percentile_approx(value, near, 10_000).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value))) + F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    distinct = df.groupBy(*tags, value).agg(F.count(value).alias("_times"))
    parted = with_carried(distinct, cuts, tags).withColumn("_part", F.when(F.col(value).isNotNull(), below)).drop("_cuts")
    places = {name: F.greatest(F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(s))).cast("long"), F.lit(1)) for name, s in shares.items()}
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*tags).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parted.groupBy(*tags, "_part").agg(F.sum("_times").alias("_size"), F.max("n").alias("_n")).withColumn("_before", before)
    held = [(p > F.col("_before")) & (p <= F.col("_before") + F.col("_size")) for p in places.values()]
    # values that are null have a part of their own, so that tags without others stay
    wanted = parts.withColumn("n", F.col("_n")).filter(reduce(or_, held) | F.col("_part").isNull()).select(*tags, "_part", "_before")
    upto = F.col("_before") + F.sum("_times").over(Window.partitionBy(*tags, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = with_carried(parted, wanted, [*tags, "_part"]).withColumn("_upto", upto)
    return placed.groupBy(*tags).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("_upto") >= place, F.col(value))).alias(name) for name, place in places.items()))


def timer(df: DataFrame, tags: list[str], value: str, exact: bool = False) -> DataFrame:
    """(tags, n, p50, p75, p99): quantiles by sketch, or exact ones."""
    if exact:
        return quantiles(df, tags, value, {"p50": "0.5", "p75": "0.75", "p99": "0.99"})
    found = df.groupBy(*tags).agg(F.count(value).alias("n"), F.percentile_approx(value, [0.5, 0.75, 0.99], 10_000).alias("q"))
    return found.select(*tags, "n", *(F.element_at("q", i + 1).alias(x) for i, x in enumerate(("p50", "p75", "p99"))))


def exported(df: DataFrame, labels: list[str], values: list[str]) -> DataFrame:
    """(name, labels, value) of every number of every row, as a scraper reads them."""
    named = F.concat_ws(",", *(F.concat(F.lit(f"{x}="), F.col(x)) for x in labels))
    each = F.array(*(F.struct(F.lit(x).alias("name"), named.alias("labels"), F.col(x).cast("double").alias("value")) for x in values))
    return df.select(F.explode(each).alias("sample")).select("sample.*")


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what an action on them will have measured on the way."""
    seen = Observation(name)
    return df.observe(seen, *(m.alias(k) for k, m in measures.items())), seen


def broker_counters(pulls: DataFrame, acks: DataFrame, most: int) -> DataFrame:
    """(subject, group, name, value) of what a broker counts for each group; counters that stayed 0 have no row."""
    size = F.col("last_pull") - F.col("first_pull") + 1
    one = F.lit(1)
    pulled = pulls.select("subject", "group", F.array(_counted("pull requests", one), _counted("pulled messages", size), _counted("short pulls", (size < most).cast("int"))).alias("counts"))
    acked = acks.select("subject", "group", F.array(_counted("ack requests", one), _counted("acked messages", size), _counted("duplicate acks", size * F.col("again"))).alias("counts"))
    each = pulled.unionByName(acked).select("subject", "group", F.explode("counts").alias("c")).groupBy("subject", "group", "c.name").agg(F.sum("c.value").alias("value"))
    return each.filter("value > 0")


def _counted(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("long").alias("value"))


def consumption(df: DataFrame, tags: list[str], created: str, pulled: str, handled_ms: Column, failed: Column) -> DataFrame:
    """(tags, n, longest_delay, handled_ms, longest_ms, failures): from creation to pull, and the handling itself."""
    late = F.unix_millis(F.col(pulled).cast("timestamp")) - F.unix_millis(F.col(created).cast("timestamp"))
    return df.groupBy(*tags).agg(F.count("*").alias("n"), F.max(late).alias("longest_delay"), F.sum(handled_ms).alias("handled_ms"), F.max(handled_ms).alias("longest_ms"), F.count_if(failed).alias("failures"))


def gauge(df: DataFrame, tags: list[str], value: str, time: str) -> DataFrame:
    """(tags, value) as last set; of several settings at one time the largest."""
    return df.groupBy(*tags).agg(F.max(F.struct(time, value)).alias("_last")).select(*tags, F.col(f"_last.{value}").alias("value"))


def last_full_minute(df: DataFrame, tags: list[str], time: str, now: Column) -> DataFrame:
    """(tags, requests) of the minute before the current one."""
    end = F.date_trunc("minute", now)
    return df.filter((F.col(time) >= end - F.make_dt_interval(mins=F.lit(1))) & (F.col(time) < end)).groupBy(*tags).agg(F.count("*").alias("requests"))
