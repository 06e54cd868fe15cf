import hashlib
import random
import struct
from collections import Counter

import regex
import xxhash

from tidelog.llm import fingerprint, queries


def brute(rows):
    """edited text's digest by (id, text), equal rows following each other."""
    def key(row):
        i, t = row
        return (i is None, -(i or 0), hashlib.md5(f"{'-' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest())

    rows = sorted(((i, t or "") for i, t in rows), key=key)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        take = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - take] + after[:take]).encode()).hexdigest()))
    return out


def test_query_edits_and_separates(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_document_fingerprints(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(brute(docs.items()))
    by_text = {}
    for r in got:
        assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited for r in got) / len(got) > 0.2 + sum(r.near_next for r in got) / len(got)
    ids = sorted(docs, reverse=True)
    prints = {r.doc_id: r for r in got}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        if docs[a] == docs[b]:
            assert prints[a].near_next == 1


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(12)))) for i in range(30)]
    rows += [(5, "é日本 text"), (5, "é日本 text"), (None, "no id"), (None, None), (7, None), (8, ""), (9, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = fingerprint.edited_fingerprints(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(brute(rows))
    prints = fingerprint.fingerprints(df).collect()
    assert len(prints) == len(rows) and prints[0].asDict().keys() == {"doc_id", "text", "fingerprint"}
    by_text = {}
    assert all(by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint for r in prints)
    assert fingerprint.edited_fingerprints(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def hashed(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed=seed % (1 << 64))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms_of(text):
    return {signed(hashed(w.encode())) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def chained(values, kind, seed):
    out = 42
    for v in values:
        out = hashed(struct.pack("<q", v), out)
    return hashed(struct.pack(kind, seed), out)


def plain_print(terms, words):
    """The fingerprint of a set of terms, subset by subset."""
    kept = sorted(terms & words)
    digits = lambda x: f"{x:016X}"[:6]
    every = 0
    for x in terms:
        every ^= hashed(struct.pack("<q", x))
    parts = [digits(chained(kept, "<i", 0)) if kept else digits(every) if terms else "-"]
    rows = [kept] * fingerprint.PER_LEVEL
    for level in range(1, fingerprint.LEVELS + 1):
        rows = [[x for x in row if not hashed(struct.pack("<i", n), hashed(struct.pack("<q", x))) >> (level - 1) & 1] for n, row in enumerate(rows)]
        parts += [digits(chained(row, "<i", level * fingerprint.PER_LEVEL + n)) if row else "-" for n, row in enumerate(rows)]
    return parts


def plain_likeness(a, b):
    for level in range(fingerprint.LEVELS, -1, -1):
        count = fingerprint.PER_LEVEL if level else 1
        begin = 1 + (level - 1) * count if level else 0
        pairs = [(x, y) for x, y in zip(a[begin : begin + count], b[begin : begin + count]) if (x, y) != ("-", "-")]
        if len(pairs) * 4 >= count * 3:
            return sum(x == y for x, y in pairs) / max(1, len(pairs))
    return float(a == b)


def test_fingerprints_against_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10**6, "Zqxone zqxtwo."), (10**6 + 1, "zqxtwo, ZQXone!"), (10**6 + 2, "zqxthree"), (10**6 + 3, "...")]
    counts = Counter(t for _, text in docs for t in terms_of(text))
    low, high = (max(2, len(docs) * share) for share in (fingerprint.LEAST_SHARE, fingerprint.MOST_SHARE))
    words = {t for t, n in counts.items() if low <= n <= high}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.h for r in fingerprint.lexicon(df).collect()} == words
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    order = sorted(docs, reverse=True)
    prints = {}
    for i, text in docs:
        prints[i] = plain_print(terms_of(text), words)
        assert got[i].fingerprint == ".".join(prints[i]), i
    for (i, text), (after, more) in zip(order, order[1:] + order[:1]):
        take = len(text) // 3
        edited = plain_print(terms_of(text[: len(text) - take] + more[:take]), words)
        assert got[i].edited_fingerprint == ".".join(edited), i
        assert abs(got[i].near_edited - plain_likeness(prints[i], edited)) < 1e-12
        assert abs(got[i].near_next - plain_likeness(prints[i], prints[after])) < 1e-12
    assert got[10**6].fingerprint == got[10**6 + 1].fingerprint != got[10**6 + 2].fingerprint


def test_long_text_and_reserved_names(spark):
    df = spark.createDataFrame([(1, "many words here " * 150_000, 5, 6), (2, "few words", 5, 6)], "doc_id long, text string, _key int, k int")
    rows = fingerprint.fingerprints(df).collect()
    assert {(r._key, r.k) for r in rows} == {(5, 6)} and len(rows) == 2
    assert fingerprint.edited_fingerprints(df).count() == 2
