"""Toxicity by non-negative positive-unlabelled learning.

A document's features are the distinct hashes of its lower-cased words and of their first four and
six bytes. A sparse linear model is trained from confirmed toxic documents and unlabelled ones. With
the share of toxic documents as prior p, the risk on clean text is estimated as the loss of the
unlabelled documents as clean ones, less p times that of the toxic ones as clean ones; where that
estimate turns negative, which no true risk can be, its step is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import _text
from tidelog.llm._learn import Adam, fold, sampled_ids, sigmoid
from tidelog.llm._stage import long_rows, unused
from tidelog.llm._text import Words, chunks, mix, named

#: Hashed features; most toxic and most unlabelled documents that training takes.
FEATURE_BITS, MOST_TOXIC, MOST_UNLABELLED = 20, 2000, 6000
#: Up to so many labelled ids are broadcast, so that texts are not shuffled to leave them out; beyond, they are joined by shuffle.
BROADCAST_KEYS = 500_000
_KINDS = (None, 4, 6)
#: A feature is telling from this ratio of frequencies and this many standard deviations on; fewer where fewer than 28 documents are confirmed.
LIFT, MARGIN = 3.0, 5.0


def features(found: Words) -> np.ndarray:
    """Features of each word: as a whole, and of its first bytes (rows as _KINDS)."""
    width = np.uint64((1 << FEATURE_BITS) - 1)
    out = []
    for kind, first in enumerate(_KINDS):
        if first is None:
            hashes = found.hashes
        else:
            hashes = _text.beginnings(found.data, found.starts, found.ends, first)
        out.append((mix(hashes + np.uint64(kind)) & width).astype(np.int32))
    return np.array(out)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            found = _text.words(named(part, "text"))
            every = features(found)
            lists = [np.unique(every[:, a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
            yield pa.record_batch([named(part, "toxic"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "features"])


def telling(toxic: np.ndarray, n_toxic: int, rest: np.ndarray, n_rest: int) -> np.ndarray:
    """Which features confirmed documents have at least LIFT times as often as unlabelled ones, by MARGIN deviations.

    `toxic` and `rest` count the documents of each feature. The margin falls with the root of the confirmed
    documents where there are fewer than 28: it is 3 at ten of them.
    """
    margin = min(MARGIN, 3 * np.sqrt(n_toxic / 10))
    expected = (rest + 1) / (n_rest + 1) * n_toxic
    return (toxic >= LIFT * expected) & (toxic - expected >= margin * np.sqrt(expected + 1))


def counted(indices: np.ndarray) -> np.ndarray:
    return np.bincount(indices, minlength=1 << FEATURE_BITS)


def _count_rows(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << FEATURE_BITS, bool)
        mask[wanted] = True
        for batch in batches:
            for part in chunks(batch):
                found = _text.words(named(part, "text"))
                every = features(found)
                kind, word = np.nonzero(mask[every])
                owner = np.searchsorted(found.bounds, word, "right") - 1
                pairs = np.unique(owner.astype(np.int64) << 32 | every[kind, word])
                used, n = np.unique(pairs & 0xFFFFFFFF, return_counts=True)
                yield pa.record_batch([pa.array(np.r_[-1, used], pa.int32()), pa.array(np.r_[part.num_rows, n], pa.int64())], ["feature", "n"])

    return run


def counts_of(docs: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents (column `text`, lower case) each of the wanted features is, and how many documents there are."""
    rows = long_rows(docs).select("text").mapInArrow(_count_rows(wanted), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = rows.column("feature").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def train(toxic: np.ndarray, lengths: np.ndarray, indices: np.ndarray, prior: float, rounds: int = 200, rate: float = 0.1, told: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias; documents are rows of `lengths` features each in `indices`, `toxic` marks the confirmed ones.

    Only telling features get a weight, so that the many words of a long text add no noise: those
    `told`, or else those that are telling in these documents.
    """
    positive = toxic.astype(bool)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if told is None:
        told = telling(counted(indices[positive[owner]]), int(positive.sum()), counted(indices[~positive[owner]]), int((~positive).sum()))
    keep = told[indices]
    used, indices = np.unique(indices[keep], return_inverse=True)
    owner = owner[keep]
    weights = {"w": np.zeros(len(used)), "b": np.full(1, np.log(prior / (1 - prior)))}
    steps = Adam(weights, rate)
    n_toxic, n_rest = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for _ in range(rounds):
        margin = np.bincount(owner, weights["w"][indices], len(lengths)) + weights["b"]
        loss_if_clean = np.logaddexp(0, margin)
        clean_risk = loss_if_clean[~positive].sum() / n_rest - prior * loss_if_clean[positive].sum() / n_toxic
        high = sigmoid(margin)
        clean_slope = np.where(positive, -prior * high / n_toxic, high / n_rest)
        toxic_slope = np.where(positive, -prior * (1 - high) / n_toxic, 0)
        slope = toxic_slope + clean_slope if clean_risk >= 0 else -clean_slope
        steps.update({"w": np.bincount(indices, slope[owner], len(used)) + 1e-4 * weights["w"], "b": slope.sum(keepdims=True)})
    full = np.zeros(1 << FEATURE_BITS)
    full[used] = weights["w"]
    return full, float(weights["b"][0])


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_column: str = "doc_id") -> tuple[np.ndarray, float]:
    """The model of a corpus and its labels (`toxic` 0 or 1), learnt from the ids that `learnable` admits.

    At most MOST_TOXIC confirmed documents and MOST_UNLABELLED documents without a label are read;
    the prior is the share of toxic ones among the admitted labels. Where every document has a label,
    those labelled 0 take the place of unlabelled ones, and where all are toxic, all admitted ones.
    Which features are telling is counted over all unlabelled documents. Without any confirmed document
    the model scores everything 0.
    """
    admitted = labels if learnable is None else labels.filter(learnable)
    counts = admitted.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("toxic")).first()
    if not counts[0]:
        return np.zeros(1 << FEATURE_BITS), -np.inf
    prior = min(0.9, counts[0] / counts[1])
    ids = docs.select(id_column) if learnable is None else docs.select(id_column).filter(learnable)
    confirmed = sampled_ids(admitted.filter("toxic = 1"), id_column, MOST_TOXIC).withColumn("toxic", F.lit(1))
    few = labels.count() <= BROADCAST_KEYS

    def keys(of: DataFrame) -> DataFrame:
        found = of.select(id_column).distinct()
        return F.broadcast(found) if few else found

    def others(of: DataFrame) -> list[DataFrame]:
        keyed = of.filter(F.col(id_column).isNotNull())
        unlabelled = keyed.join(keys(labels.filter("toxic IS NOT NULL")), id_column, "left_anti")
        return [unlabelled, keyed.join(keys(admitted.filter("toxic = 0")), id_column, "left_semi"), keyed]

    which = next((k for k, x in enumerate(others(ids)) if not x.isEmpty()), 2)
    rest = sampled_ids(others(ids)[which], id_column, MOST_UNLABELLED).withColumn("toxic", F.lit(0))
    chosen = F.broadcast(confirmed.unionByName(rest))
    rows = docs.select(F.col(id_column).alias("_id"), F.lower("text").alias("text")).join(chosen, "_id").mapInArrow(_sample_rows, "toxic int, features array<int>").toArrow().combine_chunks()
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    toxic, lengths, indices = rows.column("toxic").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    of_toxic = counted(indices[np.repeat(toxic, lengths) == 1])
    whole = docs.select(id_column, F.lower("text").alias("text"))
    of_rest, n_rest = counts_of(others(whole if learnable is None else whole.filter(learnable))[which], np.flatnonzero(of_toxic))
    told = telling(of_toxic, int(toxic.sum()), of_rest, n_rest)
    return train(toxic, lengths, indices, prior, told=told)


def score(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows with `toxicity`, 0 to 1 (a column of this name is replaced).

    Whole texts are read. Null and empty texts have no features: their score is that of the bias. An
    empty table gives an empty table.
    """
    df = long_rows(df.drop("toxicity"))
    weights, bias = model
    shared = df.sparkSession.sparkContext.broadcast((np.flatnonzero(weights).astype(np.int32), weights[np.flatnonzero(weights)], bias))
    names, lower = df.columns, unused(df, "_lower")
    held: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, offset = shared.value
        if not held:
            held.append(np.zeros(1 << FEATURE_BITS, np.float32))
            held[0][used] = values
        for batch in batches:
            for part in chunks(batch, lower):
                found = _text.words(named(part, lower))
                every = features(found)
                kind, word = np.nonzero(held[0][every])
                owner = np.searchsorted(found.bounds, word, "right") - 1
                pairs = np.unique(owner.astype(np.int64) << 32 | every[kind, word])
                margin = np.bincount(pairs >> 32, held[0][pairs & 0xFFFFFFFF], part.num_rows) + offset
                yield pa.record_batch([*(named(part, x) for x in names), pa.array(sigmoid(margin))], [*names, "toxicity"])

    return df.withColumn(lower, F.lower("text")).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, id_column: str = "doc_id") -> DataFrame:
    """Every document's (id, held_out, toxicity), learnt without the labels and texts of one fold of ids."""
    out = fold(id_column, folds) == fold_out
    model = fit(docs, labels, ~out, id_column)
    return score(docs.select(id_column, "text", out.alias("held_out")), model).drop("text")
