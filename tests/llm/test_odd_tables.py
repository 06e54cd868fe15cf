"""Very long texts and columns with the names that operators use inside, for every operator on documents."""

import re

import corpus_pipeline
import pytest
from tidelog.llm import mixing, neardup, sharding, substring
from tidelog.llm._stage import table

LONG = " ".join(f"w{k % 10_000}" for k in range(60_000))  # 350,000 characters, three times the longest given text
NAMES = "_size int, _key int, _part int, _of int, row int, n int, part int, shard_ int, sum int, before int, _sub_doc int, _sub_mark int, _sub_ranges int, _near_id int, _near_node int, _near_text int, copies_ int, bucket int, node int, id int"


def docs(spark, rows):
    names = NAMES.split(", ")
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}").repartition(3)


def kept_names(df, got):
    assert set(df.columns) <= set(got.columns)
    for r in got.collect():
        assert [r[x.split()[0]] for x in NAMES.split(", ")] == list(range(len(NAMES.split(", "))))


ROWS = [(1, LONG, "en", "a", len(LONG)), (2, LONG + " more", "en", "a", 0), (3, "a few words", None, None, None), (3, "a few words", None, None, None), (4, None, "en", "b", 0), (None, "", "en", "b", 0), (None, None, None, None, None)]


def test_near_duplicates(spark):
    df = docs(spark, ROWS)
    got = neardup.drop_near_duplicates(df)
    kept_names(df, got)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 3, 4]


def test_substring(spark):
    df = docs(spark, ROWS)
    got = substring.remove_repeats(df)
    kept_names(df, got)
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by_id[1].n_words == 60_000 and by_id[1].n_removed == 50_000 and by_id[2].n_removed == 60_000 and by_id[2].text == "more"


def test_mixing(spark):
    df = docs(spark, ROWS)
    got = mixing.mix_to_weights(df)
    kept_names(df, got)
    assert got.count() == len(ROWS) and {r.size for r in got.collect()} == {0, 3, 60_000, 60_001}


def test_sharding(spark):
    df = docs(spark, ROWS)
    got = table(sharding.numbered(sharding.assign_shards(df, 4)))
    kept_names(df, got)
    rows = got.select("shard", "slot").collect()
    for k in range(4):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path, kind):
    words = re.findall(r"\w+", LONG[:6000])
    rows = [] if kind == "empty" else [*ROWS, *((10 + i, " ".join(words[i : i + 90]) + f" only{i}", "en", "a", None) for i in range(0, 400, 40)), *[(7, "tied text of one id", "en", "c", 1), (7, "another text of this id", "en", "c", 1)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (10, 1, 0), (3, 0, 0), (3, 0, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    if kind == "empty":
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, table(stage(spark, at, str(tmp_path)))
        if name != "bpe":
            assert at.dtypes == before.dtypes, name
    rows_out = at.collect()
    assert rows_out and all(r.n_tokens > 0 for r in rows_out)
