import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidelog.llm import chat, mixing, queries, sharding


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op8_source_mixing"])
def test_query_against_sql(spark, sf_dir, name):
    oracle.check(spark, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / share for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_reaches_targets_and_survives_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "src%d" % (i % 7), "w " * int(rng.integers(1, 40))) for i in range(1500)]
    rows += [(9000 + i, None, "n " * 9) for i in range(20)] + [(9100, "tiny", "one"), (9101, "empty", ""), (9102, "empty", None), (None, "src1", "a b"), (None, "src1", "a b"), (3, "src3", "again and again")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, size int").repartition(5)
    got = mixing.mix_to_weights(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    goals = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert abs(r.target - goals[r.source]) < 1e-6
        taken[r.source] += r.size * r.copies
    assert sum(taken.values()) <= sum(sizes.values())
    for s in goals:
        assert abs(taken[s] - goals[s]) <= 41
    again = mixing.mix_to_weights(df.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix_to_weights(df.limit(0)).count() == 0
    assert {r.copies for r in mixing.mix_to_weights(df.filter("source = 'empty'")).collect()} == {0}


def test_jump_hash_against_the_loop():
    def loop(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [loop(int(k), n) for k in keys]


def test_shards_and_slots(spark, sf_dir):
    got = queries.op1_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(16))
    assert {(r.doc_id, r.slot) for r in got} == {(r.doc_id, r.slot) for r in queries.op1_sharding(spark, sf_dir).collect()}


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    rows = [(None, "a")] * 30 + [(7, "b")] * 30 + [(8, None)] + [(i, "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, slot string").repartition(6).withColumn("shard", F.lit("old"))
    got = sharding.numbered(sharding.assign_shards(df, 3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.numbered(sharding.assign_shards(df.limit(0), 3)).count() == 0


def test_chat_folding(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", "assistant", "b"), (1, 0, 3, "edit", "user", "hello\\"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "new ###"), (1, 1, 6, "delta", None, "</turn>\n"), (1, 2, 7, "delta", "user", "late"), (1, 3, 8, "message", None, None),
        (None, 0, 0, "message", "user", "x"), (2, None, None, "message", "ro:\nle", "\\n ### \\</turn>"), (2, 5, 1, "message", "assistant", "t"), (2, 5, 1, "message", "assistant", "t"),
    ]
    df = spark.createDataFrame(events, chat.EVENTS).withColumn("rendered", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in chat.format_chats(df).collect():
        role, text = chat.parse(r.rendered)
        got[r.conv_id].append((r.place, role, text, None if r.loss_start is None else chat.unescape(r.rendered[r.loss_start : r.loss_end])))
    assert sorted(got[1]) == [(0, "user", "hello\\", None), (1, "assistant", "new ###</turn>\n", "new ###</turn>\n"), (2, "user", "late", None), (3, "", "", None)]
    assert got[None] == [(0, "user", "x", None)]
    assert sorted(got[2]) == [(0, "assistant", "t", "t"), (1, "assistant", "t", "t"), (2, "ro:\nle", "\\n ### \\</turn>", None)]
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_digests_of_long_conversation(spark):
    rows = [(5, t, "assistant" if t % 2 else "user", f"text {t} " * 40) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    (r,) = chat.digests(chat.format_chats(chat.as_events(df))).collect()
    want = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in rows).encode()).hexdigest()
    assert (r.conv_id, r.n_turns, r.turns_sha256) == (5, 3000, want)
    assert r.loss_chars == sum(len(text) for _, _, role, text in rows if role == "assistant")
