import random
import re

from pyspark.sql import functions as F

from tidelog.llm.substring import remove_repeats, repeated_sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    seen, out = {}, {}
    docs = sorted({(i is None, i or 0, tuple(WORD.findall(t or ""))): (i, t) for i, t in rows}.items())
    for (_, _, words), (i, t) in docs:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = words[s : s + window]
            if seen.setdefault(key, (i, s)) != (i, s):
                for k in range(s, s + window):
                    gone[k] = True
        out[(i, t)] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def check(spark, rows, window=20, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = remove_repeats(df.withColumn("before", F.col("text")).withColumn("n_words", F.lit("x")), window, joined=True).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.text) == want[(r.doc_id, r.before)]


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(20) : rng.randrange(40, 60)]
        rows.append((i * 7, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    rows += [(2000, "same " * 50), (2001, "same " * 30), (2002, "a b " * 40)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, parts=1)


def test_repeats_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(30))
    check(spark, [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, " \n "), (5, "one")])
    check(spark, [], parts=1)


def test_stretches_keep_their_spacing(spark):
    body = "\n".join(f"t{k}" for k in range(25))
    df = spark.createDataFrame([(1, body), (2, "x\ny " + body + "\tp\tq"), (3, "as\tit is")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert got == {1: body, 2: "x\ny p\tq", 3: "as\tit is"}


def test_query_against_sql(spark, sf_dir):
    from tests import oracle
    from tidelog.llm import queries

    oracle.check(spark, queries.op10_substring_dedup, queries.ORACLES["op10_substring_dedup"], sf_dir)


def test_sketch_passes_the_driver_compressed(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(i, f"{passage} end{i}") for i in range(3)], "doc_id long, text string")
    numbers, blocks = repeated_sketch(df)
    # unpacked, a block is 32 KB
    assert len(numbers) == len(blocks) > 100 and sum(map(len, blocks)) < 1000 * len(numbers)
