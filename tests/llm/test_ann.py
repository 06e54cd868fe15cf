import math
from collections import defaultdict

import numpy as np
import pytest

from tidelog.llm import ann, queries


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    return good


def test_query_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good = brute(rows, 20)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    got = defaultdict(list)
    for r in queries.op5_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in good if i % 20 == 0}
    hits = total = 0
    for i, found in got.items():
        exact = x @ good[i]
        want = [j for j in sorted(range(len(ids)), key=lambda j: (-round(exact[j], 12), ids[j])) if ids[j] != i][:20]
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        assert all(abs(r.score - good[r.vec_id] @ good[i]) < 1e-12 for r in found)
        hits += len({ids[j] for j in want} & {r.vec_id for r in found})
        total += len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("block", [3, 2048])
def test_odd_rows_ties_and_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 5)).tolist()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, None), (201, [0.0] * 8), (202, [1.0, None]), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (205, [2.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = brute(rows, 5)
    width = 8
    full = {i: np.pad(v, (0, width - len(v))) for i, v in good.items()}
    got = defaultdict(list)
    for r in ann.nearest(df, df, k=5, tables=2, probes=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(good)
    for i in good:
        want = sorted((j for j in good if j != i), key=lambda j: (-float((full[i] * full[j]).sum()), j))[:5]
        assert got[i] == want, i
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)
    two = ann.buckets(np.random.default_rng(1).normal(size=(5, 6)), 0, 2, 4)
    assert two.shape == (5, 4) and two.max() < 16 * 16 and all(len(set(r)) == 4 for r in two)
