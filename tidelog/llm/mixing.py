"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a shuffled order, gone through up to `repeats` times. A
document's virtual finish time is the words its source has then given, divided by the source's
target; the mix is the documents in order of finish times up to the total number of words.

Cumulative sums are made in two levels: sums of the 4096 parts that the shuffle key gives a source
(or of ranges of virtual time, in each of which about as many words finish), a running sum over
those, and a running sum inside a part. So no window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._stage import table

#: Ranges of virtual time in one unit; all that finishes after two units shares the last range.
RANGES = 8192


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D (null: 0).

    Each run is replaced by one letter, whose number is then the length without white space: linear in
    the text, whereas counting matches copies the text for each of them.
    """
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """(source, source_size, target) of a table of (source, size); sources by code point, null last, get the weights in turn.

    All sources together share the sum of sizes by weight; what a source cannot give within `repeats`
    times its size is shared again by weight. The level of the water when the sources that overflow
    are full follows from running sums over the sources in the order in which they fill.
    """
    sums = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy("fills", "place")
    steps = (
        sums.withColumn("place", place)
        .withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * repeats)
        .withColumn("fills", F.col("most") / F.col("weight"))
        .withColumn("full", F.sum("most").over(filling) - F.col("most"))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(filling) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fills"), F.struct(-F.col("fills"), -F.col("place"), "level"))).over(every)["level"])
    )
    return steps.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _queued(df: DataFrame, goals: DataFrame, parts: DataFrame) -> DataFrame:
    """Each row with its place in its source's queue: `_upto`, the words given when it is done the first time."""
    ordered = Window.partitionBy("_of", "_part").orderBy("_key", "_id", "_size")
    placed = df.join(parts, ["_of", "_part"])  # by the keys of the window, so that rows are shuffled once
    placed = placed.withColumn("_upto", F.col("_before") + F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    named = goals.select(_named(F.col("source")).alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    return placed.join(F.broadcast(named) if goals.count() <= 10_000 else named, "_of")


def _named(source: Column) -> Column:
    """A source's name that is never null, in the order of sources."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def _finish(turn: Column | int) -> Column:
    return F.when(F.col("_target") > 0, (F.col("_source_size") * turn + F.col("_upto")) / F.col("_target"))


def _range(finish: Column) -> Column:
    return F.least(F.floor(finish * RANGES), F.lit(2 * RANGES)).cast("int")


def mix_to_weights(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix", id_column: str = "doc_id", size: Column | None = None) -> DataFrame:
    """The rows with `size` (words), `source_size`, `target` (of the source) and `copies` (times taken, 0 to `repeats`).

    `size` may be given as an expression; else it is the word count of `text`. Columns of the four
    names are replaced. A null source is a source, the last one. Null text has size 0. Rows of size 0
    are taken 0 times. Null ids have a shuffle key of their own; rows that agree in id, source and
    size are interchangeable. The same rows give the same result in every run. An empty table gives
    an empty table.
    """
    names = [x for x in df.columns if x not in ("size", "source_size", "target", "copies")]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    # the rows travel as one column, so that theirs and ours cannot clash
    keyed = df.select(F.struct(*names).alias("row"), F.col(id_column).alias("_id"), F.col("source").alias("source"), (word_count(F.col("text")) if size is None else size).alias("_size"), key.alias("_key"))
    keyed = keyed.withColumns({"_part": F.substring("_key", 1, 3), "_of": _named(F.col("source"))})
    slim = table(keyed.select("_id", "source", "_of", "_size", "_key", "_part"))
    goals = table(targets(slim.select("source", F.col("_size").alias("size")), weights, repeats))
    sums = slim.groupBy("_of", "_part").agg(F.sum("_size").alias("_sum"))
    so_far = Window.partitionBy("_of").orderBy("_part")
    parts = table(sums.select("_of", "_part", (F.sum("_sum").over(so_far) - F.col("_sum")).alias("_before")))

    queue = table(_queued(slim, goals, parts).filter((F.col("_size") > 0) & (F.col("_target") > 0)).drop("_part"))
    turns = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    items = turns.select("source", "_key", "turn", "_size", _finish(F.col("turn")).alias("finish")).withColumn("range", _range(F.col("finish")))
    ranges = items.groupBy("range").agg(F.sum("_size").alias("given"))
    upto = ranges.withColumn("upto", F.sum("given").over(Window.partitionBy(F.lit(0)).orderBy("range")))
    budget = goals.agg(F.sum("source_size").alias("budget"))
    edge = upto.crossJoin(budget).filter("upto > budget").groupBy("budget").agg(F.min(F.struct("range", (F.col("upto") - F.col("given")).alias("before"))).alias("edge"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("_key"), F.col("turn")]
    last = (
        items.join(F.broadcast(edge), items["range"] == edge["edge.range"])
        .withColumn("upto", F.col("edge.before") + F.sum("_size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("budget", "edge.range")
        .agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.struct("finish", F.col("source").isNull().alias("null_source"), F.coalesce("source", F.lit("")).alias("source"), "_key", "turn"))).alias("last"))
    )
    cut = last.first()

    taken = _queued(keyed, goals, parts)

    def inside(turn: int) -> Column:
        finish = _finish(turn)
        if cut is None:  # the queues end within the budget
            return finish.isNotNull().cast("int")
        if cut["last"] is None:
            return (_range(finish) < cut["range"]).cast("int")
        stop = cut["last"]
        mine = F.struct(finish.alias("finish"), F.col("source").isNull().alias("null_source"), F.coalesce("source", F.lit("")).alias("source"), F.col("_key").alias("_key"), F.lit(turn).alias("turn"))
        end = F.struct(F.lit(stop["finish"]), F.lit(stop["null_source"]), F.lit(stop["source"]), F.lit(stop["_key"]), F.lit(stop["turn"]))
        return (mine <= end).cast("int")

    copies = F.when((F.col("_size") > 0) & (F.col("_target") > 0), sum((inside(turn) for turn in range(1, repeats)), inside(0))).otherwise(0)
    return taken.select("row.*", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"))
