"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by shares of characters
and of kinds of words and encoded by a small network; gated attention, learnt from the labels of whole
documents, weighs the passages, and the weighted encoding is scored. Nothing tells the model which
passage made a document bad.

FOLDS networks are trained, each without one fold of the labelled documents. Their logits on the
documents they did not see give the logit that parts the classes best; scores are shifted so that it
is DECISION. A document's score is that of the networks' mean logit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import _text
from tidelog.llm._learn import Adam, fold, logistic, sampled_ids, sigmoid
from tidelog.llm._stage import long_rows
from tidelog.llm._text import Words, chunks, named

#: Words of a passage, most labelled documents of either class that training takes, and most passages of each of them.
PASSAGE, MOST_LABELLED, MOST_PASSAGES = 64, 1500, 64
#: Networks, and the score from which on label 1 is likelier.
FOLDS, DECISION = 4, 0.7
#: Size of the encoding and of the attention layer.
HIDDEN, ATTENTION = 32, 16
_CLASSES = 129  # each ASCII byte, and all others
_EXTRA = 7
WIDTH = _CLASSES + _EXTRA


def passages(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x WIDTH) and the bounds of each text's passages; a text without words has none."""
    lengths = np.diff(found.bounds)
    counts = -(-lengths // PASSAGE)
    bounds = np.r_[0, np.cumsum(counts)]
    n = int(bounds[-1])
    if not n:
        return np.zeros((0, WIDTH)), bounds
    inside = np.arange(len(found.hashes)) - np.repeat(found.bounds[:-1], lengths)
    of_word = np.repeat(bounds[:-1], lengths) + inside // PASSAGE
    first = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]])
    begin = found.starts[first]
    end = np.r_[begin[1:], 0]
    last_of_text = bounds[1:][counts > 0] - 1
    end[last_of_text] = found.offsets[1:][counts > 0]
    sizes = end - begin
    of_byte = np.repeat(np.arange(n), sizes)
    at = np.arange(len(of_byte)) + np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    kinds = np.minimum(found.data[at], _CLASSES - 1).astype(np.int64)
    shares = np.bincount(of_byte * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES) / sizes[:, None]
    words = np.bincount(of_word, minlength=n)
    heads, tails = found.data[found.starts], found.data[found.ends - 1]
    same = np.r_[False, (found.hashes[1:] == found.hashes[:-1]) & (of_word[1:] == of_word[:-1])]
    pairs = _distinct(of_word, found.hashes)
    each = lambda values: np.bincount(of_word, values, n) / words
    extra = [
        np.log1p(words) / np.log1p(PASSAGE),
        np.bincount(pairs, minlength=n) / words,
        each(same),
        each((heads >= 65) & (heads <= 90)),
        each((tails < 128) & ~_LETTERS[tails]),
        each(found.ends - found.starts) / 10,
        np.bincount(of_byte, (kinds >= 65) & (kinds <= 90), n) / np.maximum(1, np.bincount(of_byte, _LETTERS[kinds], n)),
    ]
    return np.column_stack([np.sqrt(shares), *extra]), bounds


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _distinct(passage: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The passage of each distinct word of each passage."""
    keys = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return (keys[np.r_[True, keys[1:] != keys[:-1]]] >> np.uint64(40)).astype(np.int64)


def _sum_of(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows between bounds (no range may be empty)."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


def forward(m: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """All layers of bags that each have a passage."""
    h = np.tanh(x @ m["w"] + m["wb"])
    t, g = np.tanh(h @ m["v"] + m["vb"]), sigmoid(h @ m["u"] + m["ub"])
    e = (t * g) @ m["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), np.diff(bounds)))
    a = e / np.repeat(_sum_of(bounds, e), np.diff(bounds))
    z = _sum_of(bounds, a[:, None] * h)
    logit = z @ m["c"] + m["cb"][0]
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": logit, "score": sigmoid(logit)}


def slopes(m: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the weighted logistic loss."""
    f = forward(m, x, bounds)
    each = np.diff(bounds)
    d = (f["score"] - y) * weight
    dz = np.repeat(d[:, None] * m["c"], each, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(_sum_of(bounds, f["a"] * da), each))
    dt, dg = de[:, None] * m["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * m["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ m["v"].T + dg @ m["u"].T) * (1 - f["h"] ** 2)
    return {"w": x.T @ dh, "wb": dh.sum(0), "v": f["h"].T @ dt, "vb": dt.sum(0), "u": f["h"].T @ dg, "ub": dg.sum(0), "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "cb": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 600, batch: int = 32, rate: float = 0.006, decay: float = 3e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """One network of labelled bags (passages x WIDTH each); rows are weighted to their classes' true shares.

    All bags are gone through 15 times at least, and more often where that is fewer than `rounds` steps.
    """
    epochs = max(15, -(-rounds * batch // len(bags)))
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    centre, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    small = lambda *size: rng.normal(0, 1 / np.sqrt(size[0]), size)
    m = {"w": small(WIDTH, HIDDEN), "wb": np.zeros(HIDDEN), "v": small(HIDDEN, ATTENTION), "vb": np.zeros(ATTENTION), "u": small(HIDDEN, ATTENTION), "ub": np.zeros(ATTENTION), "a": small(ATTENTION), "c": small(HIDDEN), "cb": np.zeros(1)}
    steps = Adam(m, rate)
    for epoch in range(epochs):
        steps.rate = rate * (1 - epoch / epochs) + rate / 20
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = (np.concatenate([bags[i] for i in rows]) - centre) / scale
            bounds = np.r_[0, np.cumsum([len(bags[i]) for i in rows])]
            found = slopes(m, x, bounds, y[rows], weight[rows] / len(rows))
            steps.update({k: v + decay * m[k] for k, v in found.items()})
    return m | {"centre": centre, "scale": scale}


def logits(networks: list[dict[str, np.ndarray]], x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean logit of the networks for bags that each have a passage."""
    return np.mean([forward(m, (x - m["centre"]) / m["scale"], bounds)["logit"] for m in networks], axis=0)


def train_folds(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
    """{networks, shift}: networks that each leave out one fold, and what is added to their mean logit."""
    part = np.zeros(len(bags), int)
    for k in (0, 1):  # each fold has its share of either class
        part[y == k] = np.arange(int((y == k).sum())) % FOLDS
    networks, seen = [], np.zeros(len(bags))
    for k in range(FOLDS):
        own, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[own])) < 2:
            own = np.arange(len(bags))
        networks.append(train([bags[i] for i in own], y[own], weight[own], seed=7 + k))
        if len(out):
            seen[out] = logits(networks[-1:], np.concatenate([bags[i] for i in out]), np.r_[0, np.cumsum([len(bags[i]) for i in out])])
    slope, bias = logistic(seen, y, weight)
    at = np.clip(-bias / slope, seen.min(), seen.max()) if slope > 0 else 0.0
    return {"networks": networks, "shift": float(np.log(DECISION / (1 - DECISION)) - at)}


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            x, bounds = passages(_text.words(named(part, "text")))
            taken = [np.unique(np.linspace(a, b - 1, min(b - a, MOST_PASSAGES)).astype(int)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([named(part, "_id").cast(pa.string()), named(part, "quality"), pa.array([x[i].astype(np.float32).tobytes() for i in taken], pa.binary())], ["id", "quality", "passages"])


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_column: str = "doc_id") -> dict | None:
    """The model of a corpus and its labels (`quality` 0 or 1), learnt from the ids that `learnable` admits.

    At most MOST_LABELLED documents of each class are read, of each at most MOST_PASSAGES passages at
    even distances, and weighted back to the classes' shares; None if a class has no document. Ids with
    both labels are left out; of several texts of one id the one with the least MD5 is taken, and an id
    that is labelled often counts once. The model depends on the rows alone, not on how they are dealt.
    """
    admitted = labels if learnable is None else labels.filter(learnable)
    each = admitted.filter("quality IN (0, 1)").groupBy(id_column).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most")
    counts = {r.quality: r["count"] for r in each.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    chosen = [sampled_ids(each.filter(F.col("quality") == k), id_column, MOST_LABELLED).withColumn("quality", F.lit(k)) for k in (0, 1)]
    found = long_rows(docs).select(F.col(id_column).alias("_id"), "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")
    found = found.groupBy("_id", "quality").agg(F.min_by("text", F.md5("text")).alias("text"))
    rows = found.mapInArrow(_sample_rows, "id string, quality int, passages binary").toArrow().sort_by("id")
    pairs = [(k, np.frombuffer(x, np.float32).reshape(-1, WIDTH)) for k, x in zip(rows.column("quality").to_pylist(), rows.column("passages").to_pylist(), strict=True) if x]
    y = np.array([k for k, _ in pairs], float)
    if len(set(y)) < 2:
        return None
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return train_folds([x for _, x in pairs], y, weight)


def score(df: DataFrame, model: dict | None) -> DataFrame:
    """The rows with `quality_score`, 0 to 1 (a column of this name is replaced).

    All passages of whole texts are read. Null texts and texts without words score 0. Without a
    model all other texts score 1. An empty table gives an empty table.
    """
    df = long_rows(df.drop("quality_score"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch):
                out = np.zeros(part.num_rows)
                found = _text.words(named(part, "text"))
                some = np.diff(found.bounds) > 0
                if m is None:
                    out[some] = 1
                elif some.any():
                    x, bounds = passages(found)
                    out[some] = sigmoid(logits(m["networks"], x, np.r_[bounds[:-1][some], bounds[-1]]) + m["shift"])
                yield pa.record_batch([*(named(part, x) for x in names), pa.array(out)], [*names, "quality_score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, fold_out: int = 2, id_column: str = "doc_id") -> DataFrame:
    """Every document's (id, held_out, quality_score), learnt without the labels of one fold of ids."""
    out = fold(id_column, folds) == fold_out
    model = fit(docs, labels, ~out, id_column)
    return score(docs.select(id_column, "text", out.alias("held_out")), model).drop("text")
