"""Toxicity with few confirmed documents, or without unlabelled ones."""

import random

import pytest

from tidelog.llm import toxicity


@pytest.mark.parametrize("kind", ["few", "all labelled"])
def test_few_confirmed_or_no_unlabelled(spark, kind):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 30 == 0 if kind == "few" else i % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(20)] + (["badword"] if bad else [])
        rows.append((i, " ".join(words)))
        if kind == "all labelled" or (bad and i < 120) or i % 7 == 1:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    step = 30 if kind == "few" else 5
    worst = min(scores[i] for i in scores if i % step == 0)
    best = max(scores[i] for i in scores if i % step)
    print(f"{kind}: least toxic {worst:.3f}, most of the others {best:.3f}")
    assert worst >= 0.5 and worst > best
