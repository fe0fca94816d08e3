"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, letters a-z and everything beyond ASCII, with A-Z in lower case. Of every window
of SPAN = 13 words the minimum of its K-gram hashes is kept, so each shared span of 13 words leaves the
same fingerprint on both sides. Documents are joined with the benchmark on fingerprints, hits are extended
to the windows around them, and a window counts only if all its words agree. An item of fewer words, but
not none, is one window of its own; for the few lengths of such items all windows of the documents are
compared. Results belong to texts: equal texts are judged once for each fingerprint hit and share the
outcome, so copies and repeated rows are no special case.

A null text has no words, isn't contaminated and matches nothing; null items are passed over. Item ids are
compared and sorted as strings. Extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.arrow import free
from folia.llm.shared import written

SPAN, K = 13, 5
_AROUND = SPAN - K + 1
#: Fingerprints up to which the benchmark's side is sent to all executors (8 bytes each).
BROADCAST_LIMIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    split = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(split, "")


def _when_size(array: Column, least: int | Column, value: Column) -> Column:
    return F.when(F.size(array) >= least, value)


def _grams(array: Column, k: int) -> Column:
    """Hashes of all runs of k entries; null where there are fewer."""
    return _when_size(array, k, F.transform(F.sequence(F.lit(0), F.size(array) - k), lambda i: F.xxhash64(F.slice(array, i + 1, k))))


def _least(hashes: Column) -> Column:
    """The least hash of each window."""
    return _when_size(hashes, _AROUND, F.transform(F.sequence(F.lit(0), F.size(hashes) - _AROUND), lambda i: F.array_min(F.slice(hashes, i + 1, _AROUND))))


def _prints(df: DataFrame, *carry: str) -> DataFrame:
    """(carry, start, print): windows such that each window has one with the same least hash at most _AROUND - 1 before it.

    They are the first of every run of windows with the same least hash and, as a gram that stands again within
    a window makes longer runs, the first beyond _AROUND windows and every _AROUND-th place behind. `df` has `words`.
    """
    mins = df.withColumn("_g", _grams(F.col("words"), K)).withColumn("_m", _least(F.col("_g"))).drop("_g")
    m = lambda i: F.get(F.col("_m"), i)
    long = lambda i: (m(i) == m(i - _AROUND)) & ((i % _AROUND == 0) | (i == _AROUND) | (m(i) != m(i - _AROUND - 1)))
    at = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (m(i) != m(i - 1)) | long(i))
    # outer: else the optimizer copies the arrays' expressions into a filter below, and their words into each step of it
    out = mins.withColumn("_at", F.when(F.col("_m").isNotNull(), at)).select(*carry, "_m", F.explode_outer("_at").alias("start"))
    return out.select(*carry, "start", F.get("_m", F.col("start")).alias("print")).where(F.col("start").isNotNull())


def _small(df: DataFrame) -> bool:
    """Whether a side has at most BROADCAST_LIMIT rows; counts no further than that."""
    return df.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, n_hit, items): for every contaminated text, by its MD5 digest, the words hit and the sorted item ids."""
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("words"))
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    spans = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - span), lambda i: F.slice("words", i + 1, span))).alias("window"))
    spans = spans.select("item", F.array_join("window", " ").alias("window"), F.size("window").alias("n")).distinct()
    windows = spans.select("window", "n").distinct().withColumn("hash", F.xxhash64("window"))
    prints = _prints(items).select("print").distinct()

    small = _small(prints)
    if small:  # the words around a hit stay in its row
        hits = _prints(texts, "key", "words").join(F.broadcast(prints), "print", "left_semi").select("key", "start", F.slice("words", F.col("start") + 1, SPAN + _AROUND - 1).alias("near"))
    else:  # only places travel, and the words are read again for the texts that are hit
        places = _prints(texts, "key").join(prints, "print", "left_semi").groupBy("key").agg(F.collect_set("start").alias("starts"))
        hits = texts.join(places, "key").select("key", "words", F.explode("starts").alias("start")).select("key", "start", F.slice("words", F.col("start") + 1, SPAN + _AROUND - 1).alias("near"))
    around = F.transform(F.sequence(F.lit(0), F.size("near") - SPAN), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice("near", i + 1, SPAN), " ").alias("window")))
    tried = hits.select("key", F.explode_outer(around).alias("w")).select("key", "w.start", "w.window", F.lit(SPAN).alias("n"))

    # at most SPAN - 1 lengths
    for n in [r["n"] for r in windows.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()]:
        every = _when_size(F.col("words"), n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("words", i + 1, n), " ").alias("window"))))
        own = windows.where(F.col("n") == n).select(F.col("window").alias("_w"))
        rows = texts.select("key", F.explode_outer(every).alias("w")).select("key", "w.start", "w.window", F.lit(n).alias("n"))
        tried = tried.unionByName(rows.join(_sized(own, _small(own)), F.col("window") == F.col("_w"), "left_semi"))

    found = tried.withColumn("hash", F.xxhash64("window")).join(_sized(windows.select("hash", F.col("window").alias("_w")), _small(windows)), "hash").where(F.col("window") == F.col("_w")).select("key", "start", "n", "window").distinct()
    found = written(found, "windows")  # read twice below
    place = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], a["end"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    by_text = found.groupBy("key").agg(place.alias("places")).select("key", covered.alias("n_hit"))
    of_items = found.select("key", "window").distinct().join(_sized(spans.select("item", "window"), _small(spans)), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return by_text.join(of_items, "key")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with n_words, n_hit, items and contaminated (in place of columns of these names)."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    key = free(docs, "_key")
    own = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    hit = find(docs, benchmark).select(F.col("key").alias(key), "n_hit", "items")
    out = own.join(hit, key, "left").drop(key)
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    judged = judge(docs.select("doc_id", "text"), benchmark)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns; no text leaves its task on the way."""
    key = free(docs, "_key")
    hit = find(docs.select("text"), benchmark).select(F.col("key").alias(key), F.col("n_hit").alias("_hit"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    sizes = docs.select(digest.alias(key), F.size(words(F.col("text"))).alias("_n")).distinct()
    gone = sizes.join(hit, key).where(F.col("_hit") * 20 >= F.col("_n")).select(key)
    return docs.withColumn(key, digest).join(gone, key, "left_anti").drop(key)
