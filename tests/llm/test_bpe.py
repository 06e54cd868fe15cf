import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidelog.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    pool = "abc deT's  \n\t\x0b\x1c\x85\u00a0\u2003é日本😀123<|endoftext|>!?.,'ll\u0300\u200d"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]
    return texts + ["", " ", "a" * 5000, "ab" * 3000, "日" * 700, "<|endoftext|>", "x" + " " * 999 + "y", "é" * 2001]


def test_same_ids_as_the_library(ranks, reference, monkeypatch):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = odd_texts()
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
    monkeypatch.setattr(bpe, "MEMO_PIECES", 40)
    for text in texts * 2:
        assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == reference.encode_ordinary(text), text
    assert encoder.encode_all([None, ""]) == [b"", b""]


def test_rows_of_pieces_as_single_ones(ranks):
    rng = random.Random(8)
    pairs = bpe.Pairs(ranks)
    for size in (2, 3, 8, 9, 31, 64):
        pieces = [bytes(rng.choice(b"etaoin shr\xc3\xa9") for _ in range(rng.randrange(2, size + 1))) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_rows(pieces, pairs)] == [bpe.merge(p, ranks) for p in pieces]


def test_leftmost_of_equal_ranks_and_long_pieces():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"aab": 258}
    assert bpe.merge(b"aaab", ranks) == [257, ord("b")]
    assert bpe.merge(b"aaaa", ranks) == [256, 256]
    assert bpe.merge(b"a" * 100_001, ranks)[-2:] == [256, 257]


def test_columns_round_trip(spark, ranks, reference):
    texts = [*odd_texts()[:50], None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(4)
    rows = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert r.n_tokens == len(r.ids) // 4
    assert bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="999999"):
        bpe.decode(spark.createDataFrame([(bytearray(np.array([999999], "<u4").tobytes()),)], "ids binary"), ranks).collect()


def test_query_against_the_library(spark, sf_dir, ranks, reference):
    from tidelog.llm.queries import op9_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op9_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
