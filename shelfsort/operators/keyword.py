"""Keyword tiers of the sub-category chain (J8) as key joins.

A candidate scores for a name by the first tier that holds:

A   the candidate is a substring of the name: 100 + its length;
A2  an alias of the candidate is a whole word of the name: 90 + longest alias;
B   words of the candidate share a five-letter beginning with a word of the
    name: 10 for each, plus their lengths.

A category of up to ``FEW`` candidates is compared pair by pair, which is linear
in the names.  In larger ones each tier is an equality join, so the work follows
the pairs that share a key, not the product:

A   every candidate is looked up by the one of its grams that is rarest among
    the names (a substring has all its grams in the text), then verified;
A2  the words of the name against the words that are aliases;
B   "one starts with the other's first five letters" is equality of five-letter
    beginnings when both have five letters; a four-letter word of one side
    meets four-letter beginnings of the other.  Words below four letters never
    count, so there are no other cases.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUB_SKIP_WORDS
from ..functions.text import latin_words, word_runs
from ..session import cut_lineage

GRAM = 3
FEW = 16


def keyword_score(nl: Column, cl: Column, aliases: Column) -> Column:
    """Tier score of one candidate for one name, both in lower case (0 = no match)."""
    a = F.when((F.length(cl) > 0) & (F.instr(nl, cl) > 0), 100 + F.length(cl))
    runs = word_runs(nl)
    hits = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.array_contains(runs, x))
    a2 = F.when(F.size(hits) > 0, 90 + F.array_max(F.transform(hits, lambda x: F.length(x))))
    skip = F.array(*[F.lit(w) for w in SUB_SKIP_WORDS])
    nwords = F.filter(latin_words(nl), lambda w: F.length(w) >= 4)
    cwords = F.filter(latin_words(cl), lambda w: (F.length(w) >= 4) & ~F.array_contains(skip, w))
    matched = F.filter(cwords, lambda cw: F.exists(nwords, lambda nw: (
        F.startswith(nw, F.substring(cw, 1, 5)) | F.startswith(cw, F.substring(nw, 1, 5)))))
    b = F.size(matched) * 10 + F.aggregate(matched, F.lit(0), lambda acc, w: acc + F.length(w))
    return F.coalesce(a, a2, b)


def alias_map(aliases: dict) -> Column:
    return F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])


def split_categories(cands: DataFrame, few: int) -> tuple[DataFrame, DataFrame, bool]:
    """Candidates of categories with at most ``few`` of them, the others, and
    whether there are others."""
    n = cut_lineage(cands.groupBy("cat_key").agg(F.count(F.lit(1)).alias("n")))
    large = n.where(F.col("n") > few).select("cat_key")
    return (cands.join(n.where(F.col("n") <= few).select("cat_key"), "cat_key", "left_semi"), cands.join(large, "cat_key", "left_semi"),
            large.limit(1).count() > 0)


def _grams(text: Column, size) -> Column:
    """Distinct substrings of ``size`` characters (none for shorter texts)."""
    last = F.length(text) - size + 1
    return F.array_distinct(F.when(last >= 1, F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size)))
        .otherwise(F.array().cast("array<string>")))


def substring_pairs(names: DataFrame, cands: DataFrame) -> DataFrame:
    """Tier A: ``(nid, cid)`` of the pairs of a category where the candidate
    (``cl``) is a substring of the name (``nl``).

    ``names``: (nid, cat_key, nl); ``cands``: (cat_key, cid, cl)."""
    size = F.least(F.length("cl"), F.lit(GRAM))
    sized = cands.where(F.length("cl") > 0).withColumn("size", size)
    # short candidates ask for shorter grams; only sizes that occur are cut
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]       # at most GRAM values
    if not sizes:
        return names.select("nid", F.lit(None).cast(cands.schema["cid"].dataType).alias("cid")).where(F.lit(False))
    text = F.col("nl")
    every = F.array_distinct(F.flatten(F.array(*[_grams(text, F.lit(s)) for s in sorted(sizes)])))
    asked = sized.select("cat_key", F.explode(_grams(F.col("cl"), F.col("size"))).alias("gram")).distinct()
    held = names.select("nid", "cat_key", F.explode(every).alias("gram")).join(asked, ["cat_key", "gram"], "left_semi")
    freq = held.groupBy("cat_key", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a candidate with a gram that no name has can't match: its rarest gram is absent
    rare = (sized.select("cat_key", "cid", F.explode(_grams(F.col("cl"), F.col("size"))).alias("gram"))
            .join(freq, ["cat_key", "gram"], "left")
            .groupBy("cat_key", "cid").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"),
                                           F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n"))
    pairs = held.join(rare, ["cat_key", "gram"]).select("nid", "cid")
    return (pairs.join(names.select("nid", "nl"), "nid").join(cands.select("cid", "cl"), "cid")
            .where(F.instr(F.col("nl"), F.col("cl")) > 0).select("nid", "cid"))


def alias_pairs(names: DataFrame, cands: DataFrame, aliases: dict) -> DataFrame:
    """Tier A2: ``(nid, cid, longest)`` where an alias is a word of the name."""
    spark = names.sparkSession
    # the alias lists are configuration: as many rows as the user wrote down
    table = spark.createDataFrame([(c, a) for c, words in aliases.items() for a in words] or [("", "")],
                                  "candidate string, alias string").where("alias <> ''")
    own = cands.join(F.broadcast(table), "candidate").select("cat_key", "cid", "alias")
    words = names.select("nid", "cat_key", F.explode(F.array_distinct(word_runs(F.col("nl")))).alias("alias"))
    return words.join(own, ["cat_key", "alias"]).groupBy("nid", "cid").agg(F.max(F.length("alias")).alias("longest"))


def prefix_pairs(names: DataFrame, cands: DataFrame) -> DataFrame:
    """Tier B: ``(nid, cid, points)`` from words that share their beginning."""
    def keys(word: Column, four: str, any_: str) -> Column:
        """Keys of a word; ``four``/``any_`` name the side whose word has four letters."""
        long_ = F.when(F.length(word) >= 5, F.concat(F.lit("5"), F.substring(word, 1, 5)))
        short = F.when(F.length(word) == 4, F.concat(F.lit(four), word))
        start = F.concat(F.lit(any_), F.substring(word, 1, 4))
        return F.filter(F.array(long_, short, start), lambda k: k.isNotNull())

    skip = F.array(*[F.lit(w) for w in SUB_SKIP_WORDS])
    cw = F.filter(latin_words(F.col("cl")), lambda w: (F.length(w) >= 4) & ~F.array_contains(skip, w))
    nw = F.array_distinct(F.filter(latin_words(F.col("nl")), lambda w: F.length(w) >= 4))
    c = (cands.select("cat_key", "cid", F.posexplode(cw).alias("at", "word"))
         .select("cat_key", "cid", "at", F.length("word").alias("len"), F.explode(keys(F.col("word"), "c", "n")).alias("key")))
    n = (names.select("nid", "cat_key", F.explode(nw).alias("word"))
         .select("nid", "cat_key", F.explode(keys(F.col("word"), "n", "c")).alias("key")).distinct())
    # a word of the candidate counts once, however many words of the name it meets
    met = n.join(c, ["cat_key", "key"]).select("nid", "cid", "at", "len").distinct()
    return met.groupBy("nid", "cid").agg((F.count(F.lit(1)) * 10 + F.sum("len")).alias("points"))


def keyword_best(names: DataFrame, cands: DataFrame, aliases: dict, few: int = FEW) -> DataFrame:
    """``(nid, candidate, kws)``: best candidate of each name's category (ties:
    lower ``cand_ord``); names without any tier give no row.

    ``names``: (nid, cat_key, name), one row per distinct name and category;
    ``cands``: (cat_key, candidate, cand_ord)."""
    n = names.select("nid", "cat_key", F.lower("name").alias("nl"))
    c = cands.select("cat_key", "candidate", F.col("cand_ord").alias("cid"), F.lower("candidate").alias("cl"))
    small, large, any_large = split_categories(c, few)
    listed = F.element_at(alias_map(aliases), F.col("candidate")) if aliases else F.lit(None).cast("array<string>")
    pair = (n.join(small, "cat_key").select("nid", "cid", keyword_score(F.col("nl"), F.col("cl"), listed).alias("kws"))
            .where(F.col("kws") > 0))
    if any_large:
        pair = pair.unionByName(_joined_scores(n, cut_lineage(large), aliases))
    best = pair.groupBy("nid").agg(F.min_by(F.struct("cid", "kws"), F.struct(-F.col("kws"), F.col("cid"))).alias("b"))
    return (best.select("nid", F.col("b.cid").alias("cid"), F.col("b.kws").alias("kws"))
            .join(c.select("cid", "candidate"), "cid").select("nid", "candidate", "kws"))


def _joined_scores(n: DataFrame, c: DataFrame, aliases: dict) -> DataFrame:
    """(nid, cid, kws) of every pair that scores, by key joins."""
    length = c.select("cid", F.length("cl").alias("len"))
    a = substring_pairs(n, c).join(length, "cid").select("nid", "cid", F.lit(0).alias("tier"), (100 + F.col("len")).alias("kws"))
    a2 = alias_pairs(n, c, aliases).select("nid", "cid", F.lit(1).alias("tier"), (90 + F.col("longest")).alias("kws"))
    b = prefix_pairs(n, c).select("nid", "cid", F.lit(2).alias("tier"), F.col("points").cast("int").alias("kws"))
    return a.unionByName(a2).unionByName(b).groupBy("nid", "cid").agg(F.min_by("kws", "tier").alias("kws"))
