"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
expressions only.

Words are runs of ASCII letters, ASCII digits and non-ASCII characters, with
A-Z lower-cased.  A window is 13 consecutive words of an item (a shorter item
is one window).  Shingles are pairs of neighbouring words, so a window of w
words is a sequence of w-1 shingles, and a document holds the window at a place
exactly when it holds all of them there in a row.

1. One pass over the documents keeps the places of those shingles that the
   benchmark has (a broadcast of the benchmark's distinct shingles when they
   are proven few, else a shuffle join).
2. Shingles are ordered by rarity in the documents.  Containment of a whole
   window needs all its shingles, so the necessary prefix is one token: the
   rarest shingle.  Windows in which a shingle never occurs are gone here.
3. Prefix places are joined to the windows that have that prefix; each gives
   one possible start.  The length and positional bounds drop starts before
   the document's first word or too near its end.
4. Verification: the pairs at start, start+1, ... must be the window's, all of
   them.  That is an equality join with the places of step 1; words themselves
   are compared, no hashes, and texts are not moved.

A document's hit words are the union of its verified windows.  Only places of
benchmark shingles are shuffled; nothing is grouped by shingle or window, so a
passage that fills a third of the corpus is spread by doc_id.

Defined cases: null and empty texts have no words and are clean; items without
words have no windows; repeated items hit alike and both count; item words in
one-word items are windows of one word; rows that repeat a doc_id (or null) and
text are judged once and get a row each, and rows of one doc_id (or null) with
other texts are documents of their own, told apart by a 128-bit digest.  An
empty benchmark leaves all documents clean; an empty table gives no rows; texts
of any length are read whole; other columns of both tables play no part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import LOWER, UPPER, join_hot, materialise, store

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_SHINGLES = 500_000
BROADCAST_WINDOWS = 100_000


def word_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def shingle_pairs(words: Column) -> Column:
    """One (a, b) per word: the word and the next one; b is null at the end."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits of SHA-256 of doc_id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """window (id), item, span (its words): one row per window of an item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(width - 1)))
    return items.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.slice("w", F.col("s"), width).alias("span"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WINDOW,
                  share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per
    document.  Contaminated: some word is hit and ``share`` * n_hit >= n_words."""
    wins = materialise(windows(benchmark, item_id, item_text, width).groupBy("span").agg(F.collect_set("item").alias("items"))
                       .withColumn("window", F.monotonically_increasing_id()))
    # Shingles of each window with their place in it; a one-word window has (word, '').
    spans = wins.select("window", F.size("span").alias("len"), F.posexplode(shingle_pairs(F.col("span"))).alias("at", "p"))
    spans = (spans.select("window", "len", "at", F.col("p.a").alias("a"), F.coalesce("p.b", F.lit("")).alias("b"))
             .where("b <> '' or len = 1"))
    sought = materialise(spans.select("a", "b").distinct().withColumn("sid", F.monotonically_increasing_id()))
    spans = materialise(spans.join(sought, ["a", "b"]).drop("a", "b"))
    n_sought = sought.count()
    small = F.broadcast if n_sought <= BROADCAST_SHINGLES else (lambda df: df)
    ones = sought.where("b = ''").limit(1).count() > 0

    number = F.col(doc_id).cast("bigint")
    pairs = (docs.select(document_key(number, F.col(text)).alias("doc"), number.alias("doc_id"), word_array(F.col(text)).alias("w"))
             .select("doc", "doc_id", F.posexplode_outer(shingle_pairs(F.col("w"))).alias("pos", "p"))
             .select("doc", "doc_id", "pos", F.col("p.a").alias("a"), F.coalesce("p.b", F.lit("")).alias("b")))
    # The last word of a document (b = '') stands for its length and id and stays.
    places = pairs.join(small(sought.where("b <> ''")), ["a", "b"], "left")
    if ones:  # single words are sought as well
        places = places.join(small(sought.where("b = ''").select("a", F.col("sid").alias("alone"))), "a", "left")
    else:
        places = places.withColumn("alone", F.lit(None).cast("bigint"))
    places = store(places.where("sid is not null or alone is not null or b = ''")
                   .select("doc", F.when(F.col("b") == "", F.col("doc_id")).alias("doc_id"), "pos", "sid", "alone",
                           (F.col("b") == "").alias("last")), "places")

    rows = places.where("last").select("doc", "doc_id", F.coalesce(F.col("pos") + 1, F.lit(0)).cast("bigint").alias("n_words"))
    sizes = rows.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    found = places.where("sid is not null").select("doc", "pos", "sid")
    if ones:
        found = found.unionByName(places.where("alone is not null").select("doc", "pos", F.col("alone").alias("sid")))

    # Copies of a document share its key: from here on each place is there once.
    found = store(found.distinct(), "found")

    # Rarity of the sought shingles, counted over all documents.
    rarity = found.groupBy("sid").agg(F.count(F.lit(1)).alias("df"))
    ranked = spans.join(rarity, "sid", "left")
    prefix = materialise(
        ranked.groupBy("window", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "sid")).alias("t"))
        .where("t.df > 0").select("window", "len", F.col("t.at").alias("at"), F.col("t.sid").alias("sid")))
    few = F.broadcast if prefix.count() <= BROADCAST_WINDOWS else (lambda df: df)
    live = prefix.select("window")
    tokens = (spans.join(few(live), "window", "left_semi").groupBy("window")
              .agg(F.collect_list(F.struct("at", "sid")).alias("tokens")))
    starts = (found.join(few(prefix), "sid")
              .select("doc", (F.col("pos") - F.col("at")).alias("start"), "window", "len").where("start >= 0")
              .join(sizes.select("doc", "n_words"), "doc").where("start + len <= n_words").drop("n_words"))
    due = (starts.join(few(tokens), "window")
           .select("doc", "start", "window", "len", F.explode("tokens").alias("t"))
           .select("doc", "start", "window", "len", (F.col("start") + F.col("t.at")).alias("pos"), F.col("t.at").alias("at"), F.col("t.sid").alias("sid")))
    whole = (due.join(found, ["doc", "pos", "sid"])
             .groupBy("doc", "start", "window", "len").agg(F.size(F.collect_set("at")).alias("n"))
             .where("n = greatest(len - 1, 1)"))
    named = whole.join(few(wins.select("window", "items").join(few(live), "window", "left_semi")), "window")
    hits = named.groupBy("doc").agg(F.collect_set(F.struct("start", "len")).alias("h"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("h", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))
    hits = hits.select("doc", covered.cast("bigint").alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    judged = hits.join(sizes.select("doc", "copies"), "doc")
    # every row takes its document's result; a document of very many copies is salted
    out = join_hot(rows.withColumn("row", F.monotonically_increasing_id()), judged, "doc", "copies", rows.count(), F.col("row")).select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.expr("n_hit > 0") & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
