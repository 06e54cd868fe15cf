"""Near-duplicate classes of documents by ProbMinHash signatures, banding and verification.

A document is the weighted set of its shingles (runs of five words; one that occurs n times weighs
1 + ln n, so that a repeated line does not drown the rest). Each shingle sends the arrivals of a Poisson process, whose rate is its weight,
to registers in an order of its own; a register keeps the first arrival, and a shingle stops as soon
as its next arrival is later than every register's. Registers of two documents agree with the
probability Jaccard similarity of their weighted sets. A document with repeated shingles gets a
second signature with all weights equal, which makes it comparable by plain Jaccard as well.

Documents that agree on all registers of a band share a bucket. Equal texts are collapsed first. In
every bucket the text that meets most others in its buckets is compared with the rest. Whatever is
then still outside its bucket's main class is compared with all texts of that class, and with the
other texts outside, in blocks where there are many; texts that the triangle inequality proves too
far from all of that class are left out. Comparisons are exact and on whole texts; classes are the connected components of the pairs that pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import _text
from tidelog.llm._stage import Tables, long_rows
from tidelog.llm._text import Words, chunks, mix, named, rolled, signed

#: Registers, a power of two; 25 bands of 5 use 125 of them. A pair at 0.8 shares no band with probability 5e-5.
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Up to so many keys (under 50 MB as rows) a side is broadcast; beyond, it is shuffled.
BROADCAST_KEYS = 500_000
#: Classes of more texts than this, and buckets with more outside their main class, are compared in blocks.
WIDE = 16
#: Bytes of text on either side of a block, about.
BLOCK = 1 << 19


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of the distinct shingles; a text of fewer words is one shingle, without words it has none."""
    at, hashes = found.grams(size)
    lengths = np.diff(found.bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    docs = np.r_[np.searchsorted(found.bounds, at, "right") - 1, short]
    hashes = np.r_[hashes, rolled(found.hashes, found.bounds[short], found.bounds[short + 1])]
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    return docs[begin], hashes[begin], np.diff(np.r_[begin, len(docs)])


def weight_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.maximum(counts, 1))


def signatures(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_docs x registers): for each the hash of the shingle that arrived first.

    All shingles send their first arrival, then those that can still win send the next, and so on.
    The k-th arrival goes to the k-th register of the shingle's own permutation; gaps are exponential
    with the rate that arrivals at the remaining registers have together.
    """
    first = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    step = (mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)).astype(np.int64)
    place = (mix(hashes ^ np.uint64(0x165667B19E3779F9)) & np.uint64(registers - 1)).astype(np.int64)
    time = np.zeros(len(docs))
    docs, weights = docs.copy(), weights.astype(float)
    for k in range(registers):
        if not len(docs):
            break
        uniform = ((mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        time = time - np.log(uniform) / weights * (registers / (registers - k))
        cell = docs * registers + ((place + k * (step & (registers - 1))) & (registers - 1))
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        winner[cell[won]] = hashes[won]
        last = first.reshape(n_docs, registers).max(axis=1)
        going = time < last[docs]
        docs, hashes, weights, time, place, step = docs[going], hashes[going], weights[going], time[going], place[going], step[going]
    return winner.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band."""
    used = registers[:, : bands * rows].reshape(len(registers), bands, rows)
    keys = np.zeros(used.shape[:2], np.uint64)
    for row in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + used[:, :, row])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _signed_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                found = _text.words(named(part, "text"))
                docs, hashes, counts = shingles(found, size)
                keys = signed(band_keys(signatures(docs, hashes, weight_of(counts), n)))
                repeats = np.zeros(n, bool)
                repeats[docs[counts > 1]] = True
                again = np.flatnonzero(repeats)
                inside = repeats[docs]
                plain = signed(band_keys(signatures(np.searchsorted(again, docs[inside]), hashes[inside], np.ones(int(inside.sum())), len(again))))
                empty = np.ones(n, bool)
                empty[docs] = False
                second = dict(zip(again.tolist(), plain, strict=True))
                bands = [[] if empty[i] else np.unique(np.r_[keys[i], second[i]]) if i in second else keys[i] for i in range(n)]
                yield pa.record_batch([named(part, "id"), named(part, "node"), pa.array(bands, pa.list_(pa.int64())), pa.array(found.offsets[1:] - found.offsets[:-1])], ["id", "node", "bands", "bytes"])

    return run


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums that start anew at each of `begin`, the value itself included."""
    upto = np.cumsum(values)
    return upto - np.repeat(np.r_[0, upto[begin[1:] - 1]], np.diff(np.r_[begin, len(values)]))


def probability_jaccards(docs: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """J_P of two weight vectors for each of n documents; rows are items with their weight on either side (0: not there)."""
    if not len(docs):
        return np.zeros(n)
    ratio = np.where(a > 0, b / np.where(a > 0, a, 1), np.inf)
    order = np.lexsort((ratio, docs))
    docs, a, b = docs[order], a[order], b[order]
    begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    below = _sums(a, begin) - a
    each = np.diff(np.r_[begin, len(docs)])
    above = np.repeat(np.add.reduceat(b, begin), each) - _sums(b, begin) + b
    both = (a > 0) & (b > 0)
    return np.bincount(docs[both], 1 / (below[both] / a[both] + above[both] / b[both]), n)


def similarities(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the plain Jaccard similarity of its two texts' shingles, and J_P of their counted ones."""
    n = len(left)
    sides = [shingles(_text.words(x), size) for x in (left, right)]
    docs, hashes = np.r_[sides[0][0], sides[1][0]], np.r_[sides[0][1], sides[1][1]]
    weight_a = np.r_[sides[0][2], np.zeros(len(sides[1][0]), int)]
    weight_b = np.r_[np.zeros(len(sides[0][0]), int), sides[1][2]]
    order = np.lexsort((hashes, docs))
    docs, hashes, weight_a, weight_b = docs[order], hashes[order], weight_a[order], weight_b[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(n), np.zeros(n)
    docs = docs[begin]
    weight_a, weight_b = np.add.reduceat(weight_a, begin), np.add.reduceat(weight_b, begin)
    both = (weight_a > 0) & (weight_b > 0)
    plain = np.bincount(docs[both], minlength=n) / np.maximum(np.bincount(docs, minlength=n), 1)
    uneven = np.zeros(n, bool)
    uneven[docs[(weight_a > 1) | (weight_b > 1)]] = True
    inside = uneven[docs]
    counted = probability_jaccards(docs[inside], *(np.where(x > 0, weight_of(x), 0)[inside] for x in (weight_a, weight_b)), n)
    return plain, np.where(uneven, counted, plain)


def block_links(outside: pa.Table, members: pa.Table, size: int, threshold: float) -> pa.Table:
    """Every near pair of a text outside a class (node, text) with one of a block of its members (node, text).

    If the rows have a class as well, only pairs of different classes.
    """
    docs, hashes, _ = shingles(_text.words(members.column("text").combine_chunks()), size)
    order = np.argsort(hashes, kind="stable")
    docs, hashes = docs[order], hashes[order]
    lengths = np.bincount(docs, minlength=members.num_rows)
    own, theirs, counts = shingles(_text.words(outside.column("text").combine_chunks()), size)
    left, right = np.searchsorted(hashes, theirs, "left"), np.searchsorted(hashes, theirs, "right")
    bounds = np.searchsorted(own, np.arange(outside.num_rows + 1))
    a, b = [], []
    for i in range(outside.num_rows):
        span = slice(bounds[i], bounds[i + 1])
        each = right[span] - left[span]
        at = np.arange(each.sum()) + np.repeat(left[span] - np.r_[0, np.cumsum(each)[:-1]], each)
        met = np.bincount(docs[at], minlength=members.num_rows)
        share = met / np.maximum(lengths + (bounds[i + 1] - bounds[i]) - met, 1)
        weight = weight_of(counts[span])
        mass = np.bincount(docs[at], np.repeat(weight, each), members.num_rows) / max(weight.sum(), 1e-300)
        b.append(np.flatnonzero((share >= threshold) | (mass >= threshold)))
        a.append(np.full(len(b[-1]), i))
    a, b = np.concatenate(a), np.concatenate(b)
    if "class" in outside.column_names:
        differ = outside.column("class").to_numpy()[a] != members.column("class").to_numpy()[b]
        a, b = a[differ], b[differ]
    near = np.zeros(len(a), bool)
    for begin in range(0, len(a), 512):
        part = slice(begin, begin + 512)
        found = similarities(outside.column("text").take(pa.array(a[part])).combine_chunks(), members.column("text").take(pa.array(b[part])).combine_chunks(), size)
        near[part] = np.maximum(*found) >= threshold
    return pa.table([outside.column("node").take(pa.array(a[near])), members.column("node").take(pa.array(b[near]))], ["a", "b"])


def _measured(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_b", _text.CHUNK_BYTES // 2):
                found = similarities(named(part, "text_a"), named(part, "text_b"), size)
                yield pa.record_batch([named(part, "a"), named(part, "b"), *map(pa.array, found)], ["a", "b", "plain", "counted"])

    return run


def _maybe_broadcast(keys: DataFrame) -> DataFrame:
    """A materialised table of keys, marked for broadcast if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of nodes with both similarities of their texts (`plain`, `counted`)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_measured(size), "a string, b string, plain double, counted double")


def _near(threshold: float) -> Column:
    return (F.col("plain") >= threshold) | (F.col("counted") >= threshold)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the least node of the connected component.

    Alternates the large star and the small star of every node until only stars are left, that is, until
    every node is either a root or on one edge to a root; each round's edges are written to the shared
    folder, and those of the round before deleted.
    """
    edges = tables.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        old, edges = edges, tables.table(small.distinct())
        tables.drop(old)
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").isEmpty():
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return tables.table(roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _in_blocks(outside: DataFrame, labelled: DataFrame, sizes: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between texts (node) and the classes (root) they are to be compared with."""
    many = outside.groupBy("root").agg(F.sum("bytes").alias("others"))
    shape = sizes.join(many, "root").select("root", F.ceil((F.col("bytes") + 1) / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("others") + 1) / BLOCK).cast("int").alias("parts"))
    here = F.pmod(F.xxhash64("node"), F.col("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    left = outside.join(shape, "root").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = labelled.join(shape, "root").withColumn("block", here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = [F.col("root").alias("root"), F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"), F.col("node").alias("node"), F.col("text").alias("text")]
    left, right = (x.join(texts, "node").select(*columns).groupBy("root", "block", "part") for x in (left, right))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string())], ["a", "b"])
        return block_links(a, b, size, threshold)

    return left.cogroup(right).applyInArrow(run, "a string, b string")


def _among_in_blocks(outside: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between texts (node) of different classes (root) that share a bucket: every block with itself and each later one."""
    shape = outside.groupBy("bucket").agg(F.ceil((F.sum("bytes") + 1) / BLOCK).cast("int").alias("blocks"))
    dealt = outside.join(shape, "bucket").withColumn("here", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = [F.col(x).alias(y) for x, y in (("bucket", "bucket"), ("block", "block"), ("part", "part"), ("node", "node"), ("root", "class"), ("text", "text"))]
    left, right = (dealt.withColumn(own, F.col("here")).withColumn(other, each).filter("part <= block") for own, other in (("part", "block"), ("block", "part")))
    left, right = (x.join(texts, "node").select(*columns).groupBy("bucket", "block", "part") for x in (left, right))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string())], ["a", "b"])
        return block_links(a, b, size, threshold)

    return left.cogroup(right).applyInArrow(run, "a string, b string")


def _remaining_links(buckets: DataFrame, middle: DataFrame, roots: DataFrame, texts: DataFrame, tested: DataFrame, tables: Tables, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between texts that share a bucket and are in different classes so far.

    One minus either similarity is a metric. A text that is further from a bucket's middle than all of
    the bucket's main class, by more than 1 - threshold in both, is near none of them.
    """
    labelled = tables.table(buckets.join(roots, "node", "left").select("bucket", "node", "bytes", F.coalesce("root", "node").alias("root")))
    counts = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    shape = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes"), (F.sum("n") - F.max("n")).alias("outside"))
    mixed = labelled.join(shape.filter("classes > 1"), "bucket").join(middle, "bucket")
    seen = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "plain", "counted")
    mixed = mixed.join(seen, (F.greatest("node", "middle") == F.col("_a")) & (F.least("node", "middle") == F.col("_b")), "left").drop("_a", "_b")
    mixed = tables.table(mixed.withColumns({x: F.when(F.col("node") == F.col("middle"), 0.0).otherwise(1 - F.col(x)) for x in ("plain", "counted")}))
    reach = mixed.filter("root = main").groupBy("bucket").agg(*((F.max(F.coalesce(x, F.lit(1.0))) + (1 - threshold) + 1e-9).alias(f"{x}_reach") for x in ("plain", "counted")))
    far = (F.col("plain") > F.col("plain_reach")) & (F.col("counted") > F.col("counted_reach"))
    outside = tables.table(mixed.filter("root <> main").join(reach, "bucket").withColumn("far", F.coalesce(far, F.lit(False))))

    # of two texts that meet in a bucket both are outside, or one is of the main class
    among = outside.filter(F.col("outside") <= WIDE).select("bucket", "node", "root")
    wide = outside.filter((F.col("outside") > WIDE) & (F.col("classes") > 2)).select("bucket", "node", "bytes", "root")
    other = among.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"))
    among = among.join(other, "bucket").filter("node > b AND root <> root_b").select(F.col("node").alias("a"), "b")

    members = tables.table(labelled.select("node", "bytes", "root").distinct())
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    against = outside.filter("NOT far").select("node", "bytes", F.col("main").alias("root")).distinct()
    against = tables.table(against.join(sizes.select("root", "n"), "root"))
    few = against.filter(F.col("n") <= WIDE).join(members.select(F.col("node").alias("b"), "root"), "root").select(F.col("node").alias("a"), "b")
    pairs = _ordered(among.union(few)).join(tested, ["a", "b"], "left_anti")
    blocks = _in_blocks(against.filter(F.col("n") > WIDE).select("node", "bytes", "root"), members, sizes, texts, size, threshold)
    links = measured(pairs, texts, size).filter(_near(threshold)).select("a", "b").union(blocks)
    return links if wide.isEmpty() else links.union(_among_in_blocks(wide, texts, size, threshold))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, node, class_id, class_size, class_node, rows) of every distinct (id, text): `node` is the text's MD5.

    Two documents are linked if their texts are equal, or if the Jaccard similarity of their distinct
    shingles, or the probability Jaccard of their counted shingles, is `threshold` or more; class_id is
    the least id of the connected documents, class_size their number of rows,
    class_node the least MD5 among them or their linked texts, and rows the number of rows with this
    very id and text.

    Null text counts as empty. Texts without words are linked to equal texts only. A text of fewer
    words than a shingle has is one shingle. Null ids stay null and are last in order: class_id is null
    only if all ids of a class are. Rows with one id and different texts are different documents.
    Other columns are not looked at. An empty table gives an empty table.
    """
    tables = Tables(long_rows(df).sparkSession)
    node = F.md5(F.coalesce("text", F.lit("")))
    docs = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), node.alias("node"))
    rows = tables.table(docs.mapInArrow(_signed_rows(size), "id long, node string, bands array<long>, bytes long"))
    nodes = tables.table(rows.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")))

    every = nodes.select("node", "bytes", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = tables.table(every.join(shared, "bucket"))
    degrees = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    middle = tables.table(buckets.select("bucket", "node").join(degrees, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("middle")))
    stars = tables.table(_ordered(buckets.select("bucket", F.col("node").alias("a")).join(middle, "bucket").select("a", F.col("middle").alias("b"))))
    wanted = _maybe_broadcast(tables.table(buckets.select("node").distinct().join(nodes.select("node", "first_id"), "node")))
    texts = tables.table(docs.join(wanted, "node").filter(F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"]))

    tested = tables.table(measured(stars, texts, size))
    links = tested.filter(_near(threshold)).select("a", "b")
    roots = components(links, tables)
    more = tables.table(_remaining_links(buckets.select("bucket", "node", "bytes"), middle, roots, texts, tested, tables, size, threshold))
    if not more.isEmpty():
        stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.union(more), tables)
    tables.keep_only(rows, nodes, roots)
    labelled = nodes.join(roots, "node", "left").select("node", "first_id", "n", F.coalesce("root", "node").alias("root"))
    classes = labelled.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = labelled.join(classes, "root").select("node", "class_id", "class_size", F.col("root").alias("class_node"))
    own = rows.groupBy("node", "id").agg(F.count("*").alias("rows"))
    return own.join(by_node, "node").select(F.col("id").alias(id_column), "node", "class_id", "class_size", "class_node", "rows")


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each class of near_duplicates: the least id, of several texts with it the least MD5, of equal rows one."""
    classes = near_duplicates(df, id_column, size, threshold)
    order: Column = F.struct(F.col(id_column).isNull().alias("last"), F.col(id_column).alias("id"), "node")
    chosen = classes.groupBy("class_node").agg(F.min_by(F.struct(F.col(id_column).alias("id"), "node", "rows"), order).alias("kept"))
    keep = chosen.select(F.col("kept.id").alias("_near_id"), F.col("kept.node").alias("_near_node"), F.col("kept.rows").alias("_near_rows"))
    node = F.md5(F.coalesce("text", F.lit("")))
    rows = df.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("_near_own"), node.alias("_near_text"))
    kept = rows.join(keep, (F.col("_near_own").eqNullSafe(F.col("_near_id"))) & (F.col("_near_text") == F.col("_near_node")))
    once = kept.filter("_near_rows = 1").select("row.*")
    several = kept.filter("_near_rows > 1").dropDuplicates(["_near_id", "_near_node"]).select("row.*")
    return once.unionByName(several)
