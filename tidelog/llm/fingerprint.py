"""I-Match fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon is the terms whose document frequency, as a share of all documents, lies in a band, which
is a band of inverse document frequencies. A document's terms are sorted and hashed through a row of
lexicon subsets: level 0 is the whole lexicon, and each of PER_LEVEL subsets at level l keeps a random
half of what it kept at level l - 1. The fingerprint is the hashes of all subsets, "-" where a document
has no term in one. Where a document has terms, but none of the lexicon, all its terms make level 0, so
that only equal sets of terms are alike. Short texts compare on full subsets, long ones on sparse ones, where single terms
decide, so that part of a text can change without changing every hash.

Terms are held as 64-bit hashes. A lexicon has at most (distinct terms per document) / LEAST_SHARE
terms, however many documents there are; it is broadcast if its count is within BROADCAST_TERMS (16 MB)
and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._stage import table

#: Levels of sparseness after the whole lexicon, and subsets of each.
LEVELS, PER_LEVEL = 8, 8
#: Shares of documents that have a term of the lexicon.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1
BROADCAST_TERMS = 1_000_000
_EMPTY = "-"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words, which are runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))


def lexicon(df: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(h), the terms of the band in column `text`; a term must be in two documents, however few there are."""
    counts = df.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    low, high = F.greatest(F.lit(2), F.col("total") * least), F.greatest(F.lit(2), F.col("total") * most)
    return counts.crossJoin(F.broadcast(total)).filter((F.col("n") >= low) & (F.col("n") <= high)).select("h")


def found_terms(df: DataFrame, key: str, columns: list[str], words: DataFrame) -> DataFrame:
    """(key, <column>_found, <column>_all ...): the sorted terms of each text that are in the lexicon, and a hash of all its terms; no row where no text has any.

    If `df` is partitioned by the key and the lexicon broadcast, nothing is shuffled.
    """
    def marked(column: str, number: int) -> Column:
        return F.transform(terms(F.col(column)), lambda x: F.struct(x.alias("h"), F.lit(number).alias("of")))

    each = [marked(c, k) for k, c in enumerate(columns)]
    rows = df.select(key, F.explode(F.concat(*each)).alias("t")).select(key, F.col("t.h").alias("h"), F.col("t.of").alias("of"))
    marked_words = words.withColumn("known", F.lit(True))
    hits = rows.join(F.broadcast(marked_words) if words.count() <= BROADCAST_TERMS else marked_words, "h", "left")
    known = [F.sort_array(F.collect_list(F.when((F.col("of") == k) & F.col("known"), F.col("h")))).alias(f"{c}_found") for k, c in enumerate(columns)]
    return hits.groupBy(key).agg(*known, *(F.bit_xor(F.when(F.col("of") == k, F.xxhash64("h"))).alias(f"{c}_all") for k, c in enumerate(columns)))


def _digits(hashed: Column) -> Column:
    return F.substring(F.lpad(F.hex(hashed), 16, "0"), 1, 6)


def _print(kept: Column, seed: int) -> Column:
    return F.when(F.size(kept) == 0, F.lit(_EMPTY)).otherwise(_digits(F.xxhash64(kept, F.lit(seed))))


def _halved(kept: Column, level: int, number: int) -> Column:
    return F.filter(kept, lambda x: F.xxhash64(x, F.lit(number)).bitwiseAND(F.lit(1 << (level - 1))) == 0)


def with_fingerprint(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the fingerprint of what found_terms gave for a column (null: no terms), which is dropped."""
    df = df.withColumns({"_kept_0": F.coalesce(F.col(f"{column}_found"), F.array().cast("array<long>")), "_kept_all": F.col(f"{column}_all")}).drop(f"{column}_found", f"{column}_all")
    parts = [F.when(F.size("_kept_0") > 0, _print(F.col("_kept_0"), 0)).otherwise(F.coalesce(_digits(F.col("_kept_all")), F.lit(_EMPTY)))]
    for level in range(1, LEVELS + 1):
        source = [F.col(f"_kept_{level - 1}_{n}" if level > 1 else "_kept_0") for n in range(PER_LEVEL)]
        df = df.withColumns({f"_kept_{level}_{n}": _halved(source[n], level, n) for n in range(PER_LEVEL)})
        parts += [_print(F.col(f"_kept_{level}_{n}"), level * PER_LEVEL + n) for n in range(PER_LEVEL)]
    kept = [x for x in df.columns if not x.startswith("_kept_")]
    return df.select(*kept, F.concat_ws(".", *parts).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes, 0 to 1, on the sparsest level where three quarters of the subsets have terms of either side.

    Where no level has, the whole lexicon decides; two fingerprints without any term are alike.
    """
    left, right = F.split(a, r"\."), F.split(b, r"\.")

    def share(level: int) -> Column:
        begin, count = (1, 1) if level == 0 else (2 + (level - 1) * PER_LEVEL, PER_LEVEL)
        both = F.zip_with(F.slice(left, begin, count), F.slice(right, begin, count), lambda x, y: F.when((x == _EMPTY) & (y == _EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
        used = F.filter(both, lambda x: x.isNotNull())
        return F.when(F.size(used) * 4 >= count * 3, F.aggregate(used, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(used), F.lit(1)))

    return F.coalesce(*map(share, range(LEVELS, -1, -1)), (a == b).cast("double"))


def fingerprints(df: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The rows with `fingerprint` of column `text` (a column of this name is replaced).

    Equal texts have equal fingerprints. Null counts as an empty text; without any term all parts are
    "-". An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.drop("fingerprint")
    words = table(lexicon(df.select(text.alias("text")), least, most))
    keyed = df.select(F.struct("*").alias("row"), F.md5(text).alias("_key"))
    found = found_terms(df.select(F.md5(text).alias("_key"), text.alias("_text")).dropDuplicates(["_key"]), "_key", ["_text"], words)
    return with_fingerprint(keyed.join(found, "_key", "left"), "_text", "fingerprint").select("row.*", "fingerprint")


def followers(ids: DataFrame, order: list[Column], key: str = "k") -> DataFrame:
    """The rows with `next_key`, the key of the row that follows in the given order (after the last: the first).

    Rows are range-partitioned and numbered inside their parts; only the parts' sizes meet in one place.
    """
    dealt = table(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    every = Window.partitionBy(F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(every.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("_total"))
    placed = table(inside.join(F.broadcast(before), "_part").withColumn("_row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))
    after = placed.select(F.col("_row").alias("_next"), F.col(key).alias("next_key"))
    return placed.withColumn("_next", F.pmod(F.col("_row") + 1, F.col("_total"))).join(after, "_next").drop("_row", "_next", "_total")


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited
    text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document's, in descending order of ids, null ids last and equal ids by the MD5 of
    id and text; after the last comes the first. Null text counts as empty. Equal rows follow each
    other. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.md5("text")))
    docs = df.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("k", k)
    words = table(lexicon(docs))
    slim = table(docs.select("k", "id", F.length("text").cast("long").alias("n_chars")))
    if not slim.groupBy("k").count().filter("count > 1").isEmpty():  # equal rows get keys of their own
        copy = F.row_number().over(Window.partitionBy("k").orderBy("id"))
        docs, slim = (x.withColumn("k", F.concat_ws(":", "k", copy)) for x in (docs, slim))
    rows = docs.select("k", "text").repartition("k")  # the one shuffle of whole texts; all that follows keeps to it
    pairs = table(followers(slim, [F.col("id").desc_nulls_last(), F.col("k")]))

    own = with_fingerprint(rows.join(found_terms(rows, "k", ["text"], words), "k", "left"), "text", "print")
    needs = pairs.select(F.col("next_key").alias("k"), F.col("k").alias("taker"), "id", "n_chars", F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    # each document sends its fingerprint to itself too, so that nobody's is made twice; as one struct, so that both uses below read one shuffle
    def sent(to: str, *fields: Column) -> Column:
        names = {"id": "long", "n_chars": "long", "take": "int", "gift": "string", "next_print": "string", "own_print": "string"}
        return F.struct(F.col(to).alias("k"), F.struct(*(x.cast(kind).alias(name) for x, (name, kind) in zip(fields, names.items(), strict=True))).alias("what"))

    none = F.lit(None)
    given = sent("taker", F.col("id"), F.col("n_chars"), F.col("take"), F.left("text", F.col("take")), F.col("print"), none)
    kept = sent("k", none, none, none, none, none, F.col("print"))
    dealt = own.join(needs, "k").select(F.explode(F.array(given, kept)).alias("sent")).select("sent.*").repartition("k")
    gifts = dealt.groupBy("k").agg(F.collect_list("what").alias("what"))
    gift = F.filter("what", lambda x: x["own_print"].isNull())[0]
    mine = F.filter("what", lambda x: x["own_print"].isNotNull())[0]["own_print"]
    both = rows.join(gifts, "k").select("k", "text", gift.alias("gift"), mine.alias("fingerprint"))
    edited = F.concat(F.left("text", (F.col("gift.n_chars") - F.col("gift.take")).cast("int")), F.col("gift.gift"))
    both = both.select("k", "gift.id", "gift.n_chars", edited.alias("edited"), "fingerprint", "gift.next_print")
    found = found_terms(both, "k", ["edited"], words)
    out = both.select("k", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_print").join(found, "k", "left")
    out = with_fingerprint(out, "edited", "edited_fingerprint")
    near = [likeness(F.col("fingerprint"), F.col(x)) for x in ("edited_fingerprint", "next_print")]
    return out.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))
