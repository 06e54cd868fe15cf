"""Removal of word sequences that already occurred in the corpus (count-min prefilter, exact second pass).

Every run of `window` consecutive words of a document is a window. Its *anchor* is the leftmost of
the smallest-hash grams inside it, so equal windows have equal anchors at equal places, and the
number of times an anchor occurs is never less than that of a window it stands for. About one
position in seven is an anchor.

1. Each task counts its anchors in count-min sketches, which are shuffled by block of cells and
   added up. The sum overestimates counts, never the reverse.
2. Only windows whose anchor is estimated to occur twice are hashed to 95 bits, reduced to the
   earliest of each task, shuffled by hash and ranked by (doc_id, start). All but the first go.

The merged sketch has `depth` rows of 2**`bits` cells, of which one bit each ("twice or more") is
broadcast, compressed: 64 MB at the defaults, whatever the input. A corpus with many more anchors than cells
only makes the prefilter let more windows through; results stay exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import _text
from tidelog.llm._stage import long_rows, unused
from tidelog.llm._text import Words, chunks, mix, named, rolled, signed

#: Cells of the sketch that travel together.
_BLOCK_BITS = 18
#: A task passes its sketch on after so many anchors, its windows after so many, and looks at so many starts at once.
_ANCHORS, _WINDOWS, _STEP = 1 << 20, 1 << 19, 1 << 15
_LAST = np.int64(2**63 - 1)


def _windows(found: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start words of windows, the anchor's start word of each, and the hash of each anchor, _STEP windows at a time."""
    gram = max(1, window * 2 // 5)
    every = _text.gram_starts(found.bounds, window)
    for begin in range(0, len(every), _STEP):
        starts = every[begin : begin + _STEP]
        low, high = starts[0], starts[-1] + window
        at = np.arange(high - low - gram + 1)
        grams = rolled(found.hashes[low:high], at, at + gram)
        anchor, least = starts.copy(), grams[starts - low]
        for shift in range(1, window - gram + 1):
            there = grams[starts - low + shift]
            lower = there < least
            least[lower] = there[lower]
            anchor[lower] = starts[lower] + shift
        yield starts, anchor, least


def _distinct_run(sorted_values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    keep = np.ones(len(sorted_values), bool)
    keep[1:] = sorted_values[1:] != sorted_values[:-1]
    return keep


def _cells(grams: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cell of each gram in one row of the sketch."""
    salt = np.uint64((row + 1) * 0x632BE59BD9B4E019 % (1 << 64))
    return (mix(grams + salt) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _partial_sketches(window: int, bits: int, depth: int) -> Callable:
    """Rows (block, cells): the distinct cells that one task saw, with a low bit for those seen more than once."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate(held)
        for row in range(depth):
            cells = np.sort(_cells(grams, bits, row))
            begin = np.flatnonzero(_distinct_run(cells))
            several = np.diff(np.r_[begin, len(cells)]) > 1
            cells = cells[begin]
            values = (cells & np.uint32((1 << _BLOCK_BITS) - 1)) << np.uint32(1) | several
            names, begins = np.unique(cells >> np.uint32(_BLOCK_BITS), return_index=True)
            ends = [*begins[1:], len(cells)]
            blobs = [zlib.compress(np.diff(values[a:b], prepend=np.uint32(0)).tobytes(), 1) for a, b in zip(begins, ends, strict=True)]
            yield pa.record_batch([pa.array(names.astype(np.int32) + (row << max(0, bits - _BLOCK_BITS))), pa.array(blobs, pa.binary())], ["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch):
                last = -1  # windows come in steps, and the first of a step may have the anchor of the last one before it
                for _, anchors, grams in _windows(_text.words(named(part, "text")), window):
                    held.append(grams[_distinct_run(anchors) & (anchors > last)])
                    last = anchors[-1]
                if sum(map(len, held)) >= _ANCHORS:
                    yield from packed(held)
                    held = []
        if held:
            yield from packed(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's sketches added up; only whether a cell counts two or more is kept."""
    once, twice, block = np.zeros(1 << _BLOCK_BITS, bool), np.zeros(1 << _BLOCK_BITS, bool), None
    for batch in batches:
        for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block = name
            values = np.cumsum(np.frombuffer(zlib.decompress(cells), np.uint32), dtype=np.uint32)
            at = values >> np.uint32(1)
            twice[at] |= once[at] | (values & np.uint32(1)).astype(bool)
            once[at] = True
    if twice.any():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 6)], pa.binary())], ["block", "twice"])


def repeated_sketch(df: DataFrame, window: int = 20, bits: int = 27, depth: int = 4) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the blocks that have cells of two or more, and those blocks, a bit for each cell: depth * 2**bits bits at most.

    Blocks stay compressed, as they pass through the driver; tasks unpack them.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(batches)

    rows = df.select("text").mapInArrow(_partial_sketches(window, bits, depth), "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, twice binary").collect()
    return np.array([row.block for row in rows], np.int64), [bytes(row.twice) for row in rows]


class _Sketch:
    """Answers, inside a task, whether an anchor is estimated to occur twice or more."""

    def __init__(self, blocks: np.ndarray, packed: list[bytes], bits: int, depth: int) -> None:
        self.bits, self.depth, self.each = bits, depth, 1 << max(0, bits - _BLOCK_BITS)
        self.slot = np.full(depth * self.each, -1, np.int64)
        self.slot[blocks] = np.arange(len(blocks))
        each = 1 << (_BLOCK_BITS - 3)
        self.packed = np.empty(len(packed) * each, np.uint8)
        for i, block in enumerate(packed):
            self.packed[i * each : (i + 1) * each] = np.frombuffer(zlib.decompress(block), np.uint8)

    def twice(self, grams: np.ndarray) -> np.ndarray:
        found = np.arange(len(grams))
        for row in range(self.depth):
            cells = _cells(grams[found], self.bits, row).astype(np.int64)
            slot = self.slot[(cells >> _BLOCK_BITS) + row * self.each]
            here = slot >= 0
            found, slot, inside = found[here], slot[here], cells[here] & ((1 << _BLOCK_BITS) - 1)
            bit = (self.packed[slot * (1 << (_BLOCK_BITS - 3)) + (inside >> 3)] >> (7 - (inside & 7)).astype(np.uint8)) & 1
            found = found[bit > 0]
        out = np.zeros(len(grams), bool)
        out[found] = True
        return out


def _candidates(found: Words, window: int, sketch: _Sketch) -> np.ndarray:
    """Start words of the windows that may be repeated."""
    out = [np.zeros(0, np.int64)]
    for starts, anchors, grams in _windows(found, window):
        new = _distinct_run(anchors)
        out.append(starts[sketch.twice(grams[new])[np.cumsum(new) - 1]])
    return np.concatenate(out)


def _keys(part: pa.RecordBatch, found: Words, id_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Document order: doc_id (null last), then 31 bits of a hash of the words, which tells texts of one id apart."""
    ids = named(part, id_column).cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
    return ids, (rolled(found.hashes, found.bounds[:-1], found.bounds[1:]) >> np.uint64(33)).astype(np.int64)


_WINDOW_ROWS = "h1 long, h2 int, doc long, at long, run int"


def _emit_windows(window: int, held: Callable[[], _Sketch], id_column: str) -> Callable:
    """Rows of candidate windows: the earliest of each hash in this task, and runs of starts known to be repeats."""

    def reduced(held_rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held_rows, strict=True)]
        held_rows.clear()
        h1, h2, doc, at = columns
        order = np.lexsort((at, doc, h2, h1))
        h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        head = np.r_[True, ~same]
        first = np.sort(order[head])  # in order of documents again: ids and places next to each other compress
        lead = np.maximum.accumulate(np.where(head, np.arange(len(h1)), 0))
        later = (doc != doc[lead]) | (at != at[lead])
        yield _window_batch(*(x[first] for x in columns), np.zeros(len(first), np.int32))
        doc, at = doc[later], at[later]
        if len(doc):
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 1)
            begin = np.flatnonzero(new)
            last = np.r_[begin[1:], len(doc)] - 1
            run = (at[last] - at[begin] + 1).astype(np.int32)
            spread = mix((doc[begin] * 31 + at[begin]).view(np.uint64))
            yield _window_batch(spread, np.full(len(begin), -1, np.int32), doc[begin], at[begin], run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, rows, count = held(), [], 0
        for batch in batches:
            for part in chunks(batch):
                found = _text.words(named(part, "text"))
                starts = _candidates(found, window, sketch)
                if not len(starts):
                    continue
                ids, marks = _keys(part, found, id_column)
                other = mix(found.hashes ^ np.uint64(0x5851F42D4C957F2D))
                for begin in range(0, len(starts), _STEP):
                    at = starts[begin : begin + _STEP]
                    low, high = at[0], at[-1] + window
                    h1, h2 = (rolled(x[low:high], at - low, at - low + window) for x in (found.hashes, other))
                    of = np.searchsorted(found.bounds, at, "right") - 1
                    rows.append((h1, (h2 >> np.uint64(33)).astype(np.int32), ids[of], (marks[of] << 32) | (at - found.bounds[of])))
                    count += len(at)
                    if count >= _WINDOWS:
                        yield from reduced(rows)
                        rows, count = [], 0
        if rows:
            yield from reduced(rows)

    return run


def _window_batch(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(signed(h1)), pa.array(h2), pa.array(doc), pa.array(at), pa.array(run)], ["h1", "h2", "doc", "at", "run"])


def _cut(data: bytes, found: Words, i: int, ranges: list[int] | None, window: int, joined: bool) -> tuple[bytes, int, int]:
    """Kept text, number of words and of removed words of text i."""
    a, b = found.bounds[i], found.bounds[i + 1]
    n = int(b - a)
    gone = np.zeros(n, bool)
    if ranges:
        packed = np.asarray(ranges, np.int64)
        edges = np.zeros(n + 1, np.int64)
        begin, run = packed >> 31, packed & 0x7FFFFFFF
        np.add.at(edges, begin, 1)
        np.add.at(edges, np.minimum(begin + run - 1 + window, n), -1)
        gone = np.cumsum(edges[:-1]) > 0
    starts, ends = found.starts[a:b], found.ends[a:b]
    if not joined and not gone.any():
        return data, n, 0
    keep = np.flatnonzero(~gone)
    breaks = np.flatnonzero(np.diff(keep) > 1) + 1
    head, tail = (keep[np.r_[0, breaks]], keep[np.r_[breaks, len(keep)] - 1]) if len(keep) else (keep, keep)
    base = found.offsets[i]
    pieces = [data[s - base : e - base] for s, e in zip(starts[head], ends[tail], strict=True)]
    if joined:
        pieces = [b" ".join(x.split()) for x in pieces]
    return b" ".join(pieces), n, int(gone.sum())


def _finish(schema_names: list[str], window: int, joined: bool, ranges_column: str | None) -> Callable:
    """The documents with their repeats cut out; without a column of ranges nothing is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield finished(part)

    def finished(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = named(part, "text")
        found = _text.words(texts)
        raw = found.data.tobytes()
        ranges = named(part, ranges_column).to_pylist() if ranges_column else [None] * part.num_rows
        out = [_cut(raw[found.offsets[i] : found.offsets[i + 1]], found, i, ranges[i], window, joined) for i in range(part.num_rows)]
        kept = pa.array([x[0].decode() for x in out], texts.type)
        counts = [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)]
        return pa.record_batch([*(kept if name == "text" else named(part, name) for name in schema_names), *counts], [*schema_names, "n_words", "n_removed"])

    return run


def remove_repeats(df: DataFrame, window: int = 20, id_column: str = "doc_id", joined: bool = False, bits: int = 27, depth: int = 4) -> DataFrame:
    """The documents without the words of windows whose word sequence starts earlier in the corpus.

    Earlier means a smaller id, or the same document and an earlier start; windows are judged on the
    input, not on what is left. `text` becomes the kept text: with `joined` the kept words joined by
    one space, else each kept stretch as it stood, stretches joined by one space. n_words and
    n_removed are added (columns of these names are replaced); every other column passes through.

    Null text: no words, and the kept text is empty. Null id: after all other ids. Rows with equal id
    and equal words are one document: all of them give the same result. Rows with equal id and
    different words are ordered by a hash of their words. Shorter texts than a window keep all words.
    An empty table gives an empty table.
    """
    df = long_rows(df.drop("n_words", "n_removed"))
    doc, mark, held_ranges = (unused(df, x) for x in ("_sub_doc", "_sub_mark", "_sub_ranges"))
    spark = df.sparkSession
    blocks = spark.sparkContext.broadcast(repeated_sketch(df, window, bits, depth))
    cache: list[_Sketch] = []

    def held() -> _Sketch:
        if not cache:
            cache.append(_Sketch(*blocks.value, bits, depth))
        return cache[0]

    windows = df.select(id_column, "text").mapInArrow(_emit_windows(window, held, id_column), _WINDOW_ROWS)
    ranked = windows.withColumn("place", F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc", "at")))
    low = (1 << 32) - 1
    packed = F.shiftleft(F.col("at").bitwiseAND(F.lit(low)), 31) + F.greatest("run", F.lit(1)).cast("long")
    repeats = (
        ranked.filter((F.col("run") > 0) | (F.col("place") > 1))
        .groupBy(F.col("doc").alias(doc), F.shiftright("at", 32).alias(mark))
        .agg(F.collect_list(packed).alias(held_ranges))
    )
    text_type = df.schema
    names = df.columns

    def split(touched: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch = held()
            for batch in batches:
                for part in chunks(batch):
                    found = _text.words(named(part, "text"))
                    hit = np.zeros(part.num_rows, bool)
                    hit[np.searchsorted(found.bounds, _candidates(found, window, sketch), "right") - 1] = True
                    keys = _keys(part, found, id_column)
                    chosen = pa.array(hit if touched else ~hit)
                    columns = [*part.columns, *map(pa.array, keys)] if touched else part.columns
                    yield pa.record_batch(columns, [*names, doc, mark][: len(columns)]).filter(chosen)

        return run

    out = T.StructType([*text_type.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    keyed = T.StructType([*text_type.fields, T.StructField(doc, T.LongType()), T.StructField(mark, T.LongType())])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _finish(names, window, joined, None)(split(False)(batches))

    clean = df.mapInArrow(untouched, out)
    joined_rows = df.mapInArrow(split(True), keyed).join(repeats, [doc, mark], "left").select(*names, held_ranges)
    cut = joined_rows.mapInArrow(_finish(names, window, joined, held_ranges), out)
    return clean.unionByName(cut)
