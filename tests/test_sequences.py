"""Two-level sequences, ranges and lookups against plain versions, and other operators on small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.operators import metrics, retry, sequence, store
from tidelog.plans import catalog
from tidelog.sources import logs
from tidelog.stage import Tables, shared_folder


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("segment", [1, 4, 1 << 20])
def test_ranges_by_segments(spark, segment):
    rng = random.Random(segment)
    values = [(k, rng.randrange(-20, 40)) for k in ("a", "b", None) for _ in range(50)]
    want = []
    for k in ("a", "b", None):
        mine = sorted({v for key, v in values if key == k})
        begin = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i] != mine[i - 1] + 1:
                want.append((k, mine[begin], mine[i - 1], i - begin))
                begin = i
    assert rows_of(sequence.ranges(table(spark, values, "k string, v long"), ["k"], "v", segment)) == sorted(want, key=repr)


@pytest.mark.parametrize("segment", [1, 7, 1 << 20])
def test_merged_ranges_and_gaps_by_segments(spark, segment):
    rng = random.Random(segment)
    pieces = [(k, lo := rng.randrange(0, 200), lo + rng.randrange(0, 12)) for k in ("a", None) for _ in range(25)]
    merged, holes = [], []
    for k in ("a", None):
        covered = sorted({v for key, lo, hi in pieces if key == k for v in range(lo, hi + 1)})
        runs = []
        for v in covered:
            if runs and v == runs[-1][1] + 1:
                runs[-1][1] = v
            else:
                runs.append([v, v])
        merged += [(k, lo, hi) for lo, hi in runs]
        ends = [-1, *(hi for _, hi in runs)]
        holes += [(k, end + 1, lo - 1) for end, (lo, _) in zip(ends, runs) if end + 1 < lo]
    df = table(spark, pieces, "k string, lo long, hi long")
    assert rows_of(sequence.merged_ranges(df, ["k"], "lo", "hi", segment)) == sorted(merged, key=repr)
    assert rows_of(sequence.gaps(df, ["k"], "lo", "hi", segment=segment)) == sorted(holes, key=repr)


@pytest.mark.parametrize("segment", [3, 1 << 20])
def test_running_values_by_segments(spark, segment):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in ("a", None) for i in rng.sample(range(60), 30)]
    df = table(spark, rows, "k string, at long, v long")
    want = {"max": [], "sum": [], "last": [], "seq": []}
    for k in ("a", None):
        seen = []
        for n, (_, i, v) in enumerate(sorted(r for r in rows if r[0] == k) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])):
            known = [x for x in seen if x is not None]
            want["max"].append((k, i, max(known, default=None)))
            want["seq"].append((k, i, n))
            seen.append(v)
            known = [x for x in seen if x is not None]
            want["last"].append((k, i, known[-1] if known else None))
    assert rows_of(sequence.running_max(df, ["k"], ["at"], "v", "x", segment).select("k", "at", "x")) == sorted(want["max"], key=repr)
    assert rows_of(sequence.last_known(df, ["k"], ["at"], "v", "x", segment).select("k", "at", "x")) == sorted(want["last"], key=repr)
    assert rows_of(sequence.with_sequence(df, ["k"], "at", "x", segment=segment).select("k", "at", "x")) == sorted(want["seq"], key=repr)


def test_weights_of_long_histories(spark):
    factor = {"timeout": 0.25, "none": 0.5, "less": 0.75, "more": 1.25, "full": 1.5}
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(4):
        weight, names = 100.0, rng.choices(list(factor), weights=(1, 1, 4, 5, 3), k=300)
        for i, name in enumerate(names):
            rows.append((k, i, name))
            weight = min(150.0, max(5.0, weight * factor[name]))
        want[k] = weight
    df = table(spark, rows, "k long, at long, outcome string")
    for segment in (1, 16, 1000):
        got = {r.k: r.weight for r in store.weights(df, ["k"], "at", segment=segment).collect()}
        assert got == pytest.approx(want, rel=1e-12)


def test_breaker_against_a_walk_call_by_call():
    def plain(state, ms, ok, failures, open_ms, successes):
        (name, bad, good, opened), changes = state, []
        for i, (at, fine) in enumerate(zip(ms.tolist(), ok.tolist())):
            if name == "open":
                if at < opened + open_ms:
                    continue
                name, good = "half-open", 0
                changes.append((i, name))
            if name == "closed":
                bad = 0 if fine else bad + 1
                if bad >= failures:
                    name, bad, opened = "open", 0, at
                    changes.append((i, name))
            elif not fine:
                name, good, opened = "open", 0, at
                changes.append((i, name))
            else:
                good += 1
                if good >= successes:
                    name, bad, good = "closed", 0, 0
                    changes.append((i, name))
        return (name, bad, good, opened), changes

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        ms, ok = np.sort(rng.integers(0, 400, n)), rng.random(n) < rng.choice([0.2, 0.5, 0.8])
        cut = int(rng.integers(0, n + 1))
        state, changes = ("closed", 0, 0, 0), []
        for a, b in ((0, cut), (cut, n)):
            if a < b:
                state, more = retry.breaker_walk(state, ms[a:b], ok[a:b], 3, 25, 2)
                changes += [(a + i, x) for i, x in more]
        want_state, want = plain(("closed", 0, 0, 0), ms, ok, 3, 25, 2)
        assert changes == want and state[0] == want_state[0]


def test_breaker_query_against_the_walk(spark, sf_dir):
    rows = logs.messages(spark, sf_dir).select("subject", "create_time", "offset", "k").collect()
    want = []
    for subject in {r.subject for r in rows}:
        mine = sorted((r for r in rows if r.subject == subject), key=lambda r: (r.create_time, r.offset))
        ms = np.array([np.datetime64(r.create_time, "ms").astype(np.int64) for r in mine])
        _, changes = retry.breaker_walk(("closed", 0, 0, 0), ms, np.array([r.k % 4 == 0 for r in mine]), 5, 3_600_000, 3)
        want += [(subject, name, int(ms[i])) for i, name in changes]
    got = [(r.subject, r.state, int(np.datetime64(r.at, "ms").astype(np.int64))) for r in catalog.QUERIES["p29_circuit_breaker"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and want


def test_dictionary_keeps_codes(spark):
    first = keys.dictionary(spark.createDataFrame([("m",), ("b",), (None,), ("b",)], "s string"), "s")
    grown = keys.dictionary(spark.createDataFrame([("a",), ("m",), ("z",), ("b",), ("\u00e4",), ("ab",)], "s string"), "s", first)
    assert {r.name: r.code for r in grown.collect()} == {"b": "000001", "m": "000002", "a": "000003", "ab": "000004", "z": "000005", "\u00e4": "000006"}


def test_checksums_are_those_of_zlib(spark, sf_dir):
    texts = {r.doc_id: r.text for r in logs.read(spark, sf_dir, "documents").collect()}
    for r in catalog.QUERIES["crc1_checksums"](spark, sf_dir).collect():
        assert r.crc == (None if texts[r.doc_id] is None else zlib.crc32(texts[r.doc_id].encode()))


def test_sketched_quantiles_are_near_in_rank(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(0, 2, 30_000)
    df = spark.createDataFrame([("a", float(v)) for v in values], "tag string, v double")
    r = metrics.timer(df, ["tag"], "v").first()
    for p, found in ((0.5, r.p50), (0.75, r.p75), (0.99, r.p99)):
        assert abs((values <= found).mean() - p) < 0.001


def test_exact_quantiles_are_those_of_sorting(spark):
    rng = np.random.default_rng(6)
    tables = {"many": rng.lognormal(0, 2, 30_000), "ties": np.r_[np.full(700, 3.0), rng.normal(0, 9, 300)], "one": np.array([-1.5]), "same": np.full(400, 2.5), "few": np.arange(4.0)}
    rows = [(tag, float(v)) for tag, values in tables.items() for v in values] + [("ties", None), ("none", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "tag string, v double")
    found = {r.tag: tuple(r)[1:] for r in metrics.timer(df, ["tag"], "v", exact=True).collect()}
    want = {tag: (len(v), *(float(np.sort(v)[max(-(-len(v) * per // 100), 1) - 1]) for per in (50, 75, 99))) for tag, v in tables.items()}
    assert found == want | {"none": (0, None, None, None), None: (1, 7.0, 7.0, 7.0)}


def test_metrics_are_observed_on_the_way(spark):
    df, seen = metrics.observed(spark.range(10), "run", rows=F.count("*"), last=F.max("id"))
    assert df.filter("id > 3").count() == 6 and seen.get == {"rows": 10, "last": 9}


def test_lookups_push_their_filters(spark, sf_dir):
    plan = catalog.QUERIES["src9_point_lookup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject,click)" in plan and "EqualTo(seq,7)" in plan and "Window" not in plan


def test_tables_are_deleted(spark):
    tables = Tables(spark)
    a, b = tables.table(spark.range(3)), tables.table(spark.range(4))
    tables.keep_only(b)
    assert b.count() == 4 and shared_folder(spark).endswith(spark.sparkContext.applicationId)
    with pytest.raises(Exception):
        a.count()
