import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import _text, neardup
from tidelog.llm._stage import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def plain(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a and b else 0.0


def weighted(a, b):
    a, b = ({k: 1 + math.log(n) for k, n in x.items()} for x in (a, b))
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return total


def near(a, b, threshold):
    if plain(a, b) >= threshold:
        return True
    common = sum(1 + math.log(a[k]) for k in a.keys() & b.keys())
    return bool(a) and common >= threshold * sum(1 + math.log(n) for n in a.values()) and weighted(a, b) >= threshold


def brute(rows, threshold=0.8):
    """class id by (id, text), and the pairs of different texts that are near."""
    items = sorted({(i is None, i or 0, t or "") for i, t in rows})
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [grams(t) for *_, t in items]
    for x in range(len(items)):
        for y in range(x):
            if items[x][2] == items[y][2] or near(sets[x], sets[y], threshold):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {(None if n else i, t): (None if items[find(k)][0] else items[find(k)][1]) for k, (n, i, t) in enumerate(items)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(900)]
    rows, line = [], [rng.choice(vocabulary) for _ in range(25)]
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 260))]
        if i % 4 == 0:
            words += line * rng.randrange(1, 4)
        rows.append((i, " ".join(words)))
        for k in range(rng.randrange(4)):
            edited = list(words)
            for _ in range(rng.randrange(1 + len(words) // 60)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((100 + 10 * i + k, " ".join(edited)))
    rows += [(900 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "few words"), (2004, "few words"), (2005, "few  words"), (None, rows[3][1]), (None, "alone and without an id here"), (7, "another text under an old id"), (2003, "few words")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide", [0, 16])
def test_classes_against_all_pairs(spark, monkeypatch, wide):
    rows = corpus()
    monkeypatch.setattr(neardup, "WIDE", wide)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, rows int")
    import hashlib

    by_node = {hashlib.md5((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    got = neardup.near_duplicates(df).collect()
    want = brute(rows)
    assert {(r.doc_id, by_node[r.node]): r.class_id for r in got} == want
    assert sum(r.rows for r in got) == len(rows)
    kept = neardup.drop_near_duplicates(df).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "node", "rows"}
    assert len(kept) == len({r.class_node for r in got})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(v for v in {r.class_node: r.class_id for r in got}.values() if v is not None)


def test_wide_bucket_and_hot_group(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(neardup, "WIDE", 3)
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(38)])) for i in range(80)]
    base = [f"b{k}" for k in range(200)]
    for i in range(80):
        words = list(base)
        words[rng.randrange(200)] = f"e{i}"
        words[rng.randrange(200)] = f"f{i}"
        rows.append((500 + i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    by_id = {i: t for i, t in rows}
    assert {(r.doc_id, by_id[r.doc_id]): r.class_id for r in got} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.drop_near_duplicates(df).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_registers_estimate_probability_jaccard(share):
    rng = np.random.default_rng(1)
    n = 400
    common = int(n * share)
    a = [f"x{i}" for i in range(n)]
    b = a[:common] + [f"y{i}" for i in range(n - common)]
    wa, wb = rng.integers(1, 6, n), rng.integers(1, 6, n)
    items = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    va, vb = np.zeros(len(items)), np.zeros(len(items))
    for w, x in zip(a, wa):
        va[items[w]] = x
    for w, x in zip(b, wb):
        vb[items[w]] = x
    hashes = _text.mix(np.arange(len(items), dtype=np.uint64))
    agree = []
    for salt in range(40):
        h = _text.mix(hashes + np.uint64(salt * 977))
        docs = np.r_[np.zeros(n, int), np.ones(n, int)]
        pick = np.r_[[items[w] for w in a], [items[w] for w in b]]
        q = neardup.signatures(docs, h[pick], np.r_[wa, wb], 2)
        agree.append((q[0] == q[1]).mean())
    one = np.zeros(len(va), int)
    exact = neardup.probability_jaccards(one, va, vb, 1)[0]
    counted = [Counter(dict(zip(x, w.tolist()))) for x, w in ((a, wa), (b, wb))]
    assert abs(neardup.probability_jaccards(one, *(np.where(v > 0, neardup.weight_of(v), 0) for v in (va, vb)), 1)[0] - weighted(*counted)) < 1e-9
    assert abs(np.mean(agree) - exact) < 0.025


def test_similarities_of_texts():
    a, b = pa.array(["a b c d e f g", "x " * 30, None, "one"]), pa.array(["a b c d e f h", "x " * 40, "p q", "one"])
    got = neardup.similarities(a, b, 5)
    assert np.allclose(got, [[0.5, 1.0, 0.0, 1.0]] * 2)


def test_similarities_of_many_counted_texts():
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefg") for _ in range(12)) for _ in range(6)]
    left, right = ([" ".join(rng.choice(lines) for _ in range(rng.randrange(0, 9))) for _ in range(60)] for _ in "ab")
    plain_, counted = neardup.similarities(pa.array(left), pa.array(right), 5)
    assert np.allclose(plain_, [plain(grams(a), grams(b)) for a, b in zip(left, right)])
    assert np.allclose(counted, [weighted(grams(a), grams(b)) for a, b in zip(left, right)])


def test_distances_obey_the_triangle_inequality():
    """One minus either similarity is a metric, which is what lets far texts be left out."""
    rng = random.Random(8)
    for _ in range(300):
        x, y, z = (Counter(rng.choices("abcdefgh", k=rng.randrange(1, 20))) for _ in "xyz")
        for f in (plain, weighted):
            assert 1 - f(x, z) <= 2 - f(x, y) - f(y, z) + 1e-9


@pytest.mark.parametrize("kind", ["chain", "stars", "random", "none"])
def test_components_against_union(spark, kind):
    rng = np.random.default_rng(5)
    edges = {
        "chain": [(i, i + 1) for i in range(40)] + [(100, 100)],
        "stars": [(0, i) for i in range(1, 30)] + [(60, i) for i in range(50, 60)],
        "random": rng.integers(0, 120, (90, 2)).tolist(),
        "none": [],
    }[kind]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "a string, b string")
    found = neardup.components(df, Tables(spark)).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"{a:04d}", f"{b:04d}") for a, b in root.items())
