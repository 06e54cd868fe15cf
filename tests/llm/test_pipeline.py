"""Every stage of the pipeline held against a plain version on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_neardup import grams, plain
from tests.llm.test_substring import brute
from tidelog.llm import bpe
from tidelog.llm._stage import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = table(stage(spark, docs, sf_dir))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    for name in ("quality", "near_dedup", "substring_dedup", "mixing"):
        assert stages[name].dtypes == stages["input"].dtypes


def test_quality_keeps_good_documents(spark, stages):
    kept = by_id(stages["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in bad]) < 0.2


def test_one_document_of_each_class(stages):
    before, after = by_id(stages["quality"]), by_id(stages["near_dedup"])
    sets = {i: grams(r.text) for i, r in before.items()}
    kept = list(after)
    for x, i in enumerate(kept):
        for j in kept[:x]:
            assert plain(sets[i], sets[j]) < 0.8
    for i in set(before) - set(after):
        assert any(plain(sets[i], sets[j]) >= 0.8 or before[i].text == before[j].text for j in before if j != i)


def test_no_repeated_window_is_left(stages):
    before, after = by_id(stages["near_dedup"]), by_id(stages["substring_dedup"])
    assert set(before) == set(after)
    want = brute([(i, r.text) for i, r in before.items()], 20)
    for i, r in after.items():
        assert WORD.findall(r.text) == want[(i, before[i].text)][2].split(" ") or not r.text and not want[(i, before[i].text)][2]
        assert r.n_chars == len(r.text)


def test_mix_takes_whole_documents_up_to_the_budget(stages):
    before, rows = by_id(stages["substring_dedup"]), stages["mixing"].collect()
    size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
    copies = Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 3 and all(before[r.doc_id].text == r.text for r in rows)
    assert 0.9 * sum(size.values()) < sum(size[i] * n for i, n in copies.items()) <= sum(size.values())


def test_tokens_of_every_row(stages):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = defaultdict(list)
    for r in stages["mixing"].collect():
        texts[r.doc_id].append(r.text)
    rows = stages["bpe"].collect()
    assert Counter(r.doc_id for r in rows) == {i: len(x) for i, x in texts.items()}
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id][0])
