"""Nearest neighbours are found whatever the lengths and widths of vectors."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann

SF = "/root/testdata/sf0.1"


def given(spark):
    return np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)


def recall(spark, x, k=20, every=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in ann.nearest(df, df.filter(f"vec_id % {every} = 0"), k=k).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for i in range(0, len(x), every):
        scores = x @ x[i]
        scores[i] = -np.inf
        want = set(np.argsort(-scores)[: min(k, len(x) - 1)].tolist())
        hits, total = hits + len(want & got[i]), total + len(want)
    return hits / total, min(len(got[i]) for i in range(0, len(x), every))


@pytest.mark.parametrize("kind", ["one 1% longer", "one 10x longer", "one 100x longer", "unequal", "wide", "clustered"])
def test_recall_of_unequal_lengths_and_wide_vectors(spark, kind):
    rng = np.random.default_rng(0)
    x = given(spark)
    if kind == "unequal":
        x *= np.exp(0.5 * rng.normal(size=len(x)))[:, None]
    elif kind == "wide":
        x = rng.normal(size=(2000, 256))
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "clustered":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 64))
    else:
        x[7] *= {"one 1% longer": 1.01, "one 10x longer": 10, "one 100x longer": 100}[kind]
    found, _ = recall(spark, x)
    print(f"recall {kind}: {found:.4f}")
    assert found >= 0.9


def test_recall_does_not_fall_with_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10**12)
    monkeypatch.setattr(ann.F, "count", lambda *_: F.max(F.lit(10**9)))  # every count says a thousand million
    found, least = recall(spark, given(spark))
    print(f"recall of a large table: {found:.4f}, least rows {least}")
    assert found >= 0.9


@pytest.mark.parametrize("rows", [21, 12])
def test_few_candidates_are_all_returned(spark, rows):
    found, least = recall(spark, given(spark)[:rows], every=1)
    print(f"recall of {rows} rows: {found:.4f}, least rows {least}")
    assert found == 1 and least == min(20, rows - 1)
