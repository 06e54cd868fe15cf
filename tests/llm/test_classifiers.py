import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import _text, quality, queries, toxicity


def test_query_accuracy_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, kind, least in (("op2_quality_classifier", "quality", 0.97), ("op7_toxicity", "toxic", 0.93)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        held = [(r.predicted, labels[r.doc_id][kind]) for r in rows if r.held_out and r.doc_id in labels]
        assert len(held) > 50 and np.mean([a == b for a, b in held]) >= least, name
        again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, sf).collect()}
        assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    scores = [{r.doc_id: r.quality_score for r in quality.held_out_scores(d, labels).collect()} for d in (docs, docs.repartition(5))]
    assert scores[0].keys() == scores[1].keys() and all(abs(v - scores[1][k]) < 1e-9 for k, v in scores[0].items())


def plain_quality(model, text):
    """A document's score by one passage after the other, as the module's description says."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0.0
    logits = []
    for m in model["networks"]:
        h, e = [], []
        x, _ = quality.passages(_text.words(pa.array([text])))
        for row in (x - m["centre"]) / m["scale"]:
            hidden = np.tanh(row @ m["w"] + m["wb"])
            gate = 1 / (1 + np.exp(-(hidden @ m["u"] + m["ub"])))
            h.append(hidden)
            e.append(math.exp((np.tanh(hidden @ m["v"] + m["vb"]) * gate) @ m["a"]))
        assert len(h) == -(-len(words) // quality.PASSAGE)
        logits.append(sum(w / sum(e) * v for w, v in zip(e, h)) @ m["c"] + m["cb"][0])
    return 1 / (1 + math.exp(-np.mean(logits) - model["shift"]))


def plain_toxicity(model, text):
    weights, bias = model
    words = set(re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode()))
    found = set()
    for word in words:
        found |= set(toxicity.features(_text.words(pa.array([word.decode()]))).ravel().tolist())
    return 1 / (1 + math.exp(-sum(weights[i] for i in found) - bias))


def test_scores_against_plain_versions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for kind, column, plain in ((quality, "quality_score", plain_quality), (toxicity, "toxicity", plain_toxicity)):
        model = kind.fit(docs, labels)
        for r in kind.score(docs, model).collect():
            assert abs(r[column] - plain(model, texts[r.doc_id])) < 1e-5, (column, r.doc_id)


def test_labels_that_disagree_or_repeat(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["good", "fine", "text"] if i % 2 else ["$$", "##", "!!"], 80))) for i in range(40)]
    repeats = [(1, docs[1][1])] * 50 + [(3, "another text of id three")]
    labels = [(i, i % 2, 1 - i % 2) for i in range(40)]
    clash = [(0, 1, 1), (0, 1, 1), (2, None, None), (None, 1, 1)]
    many, few = spark.createDataFrame(docs + repeats, "doc_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    marked = spark.createDataFrame(labels + clash, "doc_id long, quality int, toxic int")
    model = quality.fit(many, marked)
    scores = {r.doc_id: r.quality_score for r in quality.score(few, model).collect()}
    assert all((scores[i] >= quality.DECISION) == bool(i % 2) for i in range(2, 40))
    only = quality.fit(few, spark.createDataFrame([r for r in labels if r[0]], "doc_id long, quality int, toxic int"))
    assert model["networks"][0]["w"].shape == only["networks"][0]["w"].shape
    model = toxicity.fit(many, marked)
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(many, model).collect())


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_long_text_and_reserved_names(spark, kind):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "word " * 400_000 if i == 3 else f"w{i} $ text", 7, "K") for i in range(8)], "doc_id long, text string, _lower int, _id string")
    rows = kind.score(docs, kind.fit(docs, labels)).collect()
    assert len(rows) == 8 and {(r._lower, r._id) for r in rows} == {(7, "K")} and rows[3].text == "word " * 400_000


def test_attention_slopes_against_differences():
    rng = np.random.default_rng(0)
    m = quality.train([rng.normal(size=(3, quality.WIDTH)) for _ in range(6)], np.array([0, 1] * 3, float), np.ones(6), rounds=1)
    x, bounds, y, weight = rng.normal(size=(7, quality.WIDTH)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        s = quality.forward(m, x, bounds)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    found = quality.slopes(m, x, bounds, y, weight)
    for k, slope in found.items():
        flat = m[k].reshape(-1)
        i = int(np.abs(slope).reshape(-1).argmax())
        flat[i] += 1e-5
        high = loss()
        flat[i] -= 2e-5
        low = loss()
        flat[i] += 1e-5
        assert abs((high - low) / 2e-5 - slope.reshape(-1)[i]) < 1e-4, k


def test_passages_of_texts():
    x, bounds = quality.passages(_text.words(pa.array(["w " * 130, None, "", "AB cd, AB AB"])))
    assert bounds.tolist() == [0, 3, 3, 3, 4] and x.shape == (4, quality.WIDTH)
    assert np.allclose(x[3, 129 + 1 : 129 + 6], [0.5, 0.25, 0.75, 0.25, 0.225])
    assert np.allclose((x[:, :129] ** 2).sum(axis=1), 1)


def test_non_negative_risk_finds_planted_words():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 5000, (3000, 30))
    toxic = np.r_[np.ones(500), np.zeros(2500)]
    bad = np.r_[np.ones(500, bool), rng.random(2500) < 0.1]
    rows = [np.unique(np.r_[row, 900_000 + rng.integers(0, 5, 2)] if b else row) for row, b in zip(common, bad)]
    w, b = toxicity.train(toxic, np.array([len(r) for r in rows]), np.concatenate(rows), 0.1)
    hit = np.array([w[r].sum() + b > 0 for r in rows])
    assert (hit == bad).mean() > 0.99


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_odd_rows_and_missing_labels(spark, kind):
    column = "quality_score" if kind is quality else "toxicity"
    docs = spark.createDataFrame([(1, "a b c", 1), (None, None, 2), (2, "", 3), (2, "", 3), (3, " \n", 4)], f"doc_id long, text string, {column} int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = kind.fit(docs, labels)
    rows = kind.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r[column] <= 1 for r in rows)
    assert kind.score(docs.limit(0), model).count() == 0
    assert kind.held_out_scores(docs, labels).count() == 5
