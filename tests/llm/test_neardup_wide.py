"""Texts that share a single wide bucket are compared, too."""

import random

from tidelog.llm import neardup
from tidelog.llm._stage import Tables


def test_pairs_of_one_wide_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WIDE", 3)
    monkeypatch.setattr(neardup, "BLOCK", 1500)
    rng = random.Random(5)
    texts = {"z": " ".join(f"z{k}" for k in range(60))}  # the main class
    for i in range(15):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts[f"a{i:02}"] = " ".join(words)
        texts[f"b{i:02}"] = " ".join([*words[:-1], "other"])
    buckets = spark.createDataFrame([(1, n, len(t)) for n, t in texts.items()], "bucket long, node string, bytes long")
    middle = spark.createDataFrame([(1, "z")], "bucket long, middle string")
    roots = spark.createDataFrame([("a00", "b00"), ("b00", "b00")], "node string, root string")
    stars = spark.createDataFrame([], "a string, b string, plain double, counted double")
    rows = neardup._remaining_links(buckets, middle, roots, spark.createDataFrame(list(texts.items()), "node string, text string"), stars, Tables(spark), 5, 0.8).collect()
    found = {tuple(sorted((r.a, r.b))) for r in rows}
    assert found == {(f"a{i:02}", f"b{i:02}") for i in range(1, 15)}
