"""Best token-set match with argmax (J9) by bounds instead of all pairs.

For a name and a candidate of its category with k common tokens, every part of
the token-set ratio but one follows from the lengths: the ratios against the
common tokens are closed forms, and the last one needs a longest common
subsequence of the two rests, which is at most as long as the shorter rest.

A category of up to ``FEW`` candidates is scored pair by pair, which is linear in
the names.  In larger ones:

1. Pairs with a common token come from an equality join.  Their closed forms
   give each name a lower bound, their lengths an upper bound per pair.  The
   ``FIRST`` pairs with the largest bounds are scored exactly, then those whose
   bound still reaches the best score found.
2. Pairs without a common token score the ratio of their sorted tokens.  The
   lossless blocking of ``fuzzy.py`` finds all that reach a threshold; a name
   whose best score is not below it leaves, since all that is unseen scores
   less.  Several falling thresholds may be given; under about 84 the blocking
   works on single characters and is rarely worth it.
3. Names still open meet their category once more, but only as far as a bound:
   the characters that both texts have, with their number.  Pairs whose bound
   reaches the name's best score are scored exactly, best bounds first.

Only the exact scores run the subsequence kernel; ``stats`` counts them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzz import indel_ratio, lcs_len, token_set_ratio
from ..functions.text import split_ws
from ..session import cut_lineage
from .fuzzy import similar_pairs
from .keyword import FEW, split_categories

FIRST = 4
THRESHOLDS = (85.0,)
_EPS = 1e-9


def _tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(split_ws(text)))


def _sized(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cat_key, text, tokens, letters): distinct tokens and their total length."""
    return df.select(F.col(key), "cat_key", F.col(text), _tokens(F.col(text)).alias("tokens")).withColumn(
        "letters", F.aggregate("tokens", F.lit(0), lambda a, t: a + F.length(t)))


def shared_pairs(names: DataFrame, cands: DataFrame) -> DataFrame:
    """Pairs with a common token: (nid, cid, li, la, lb, low, high): lengths of
    the common tokens and of both rests, bounds of the score."""
    n = names.select("nid", "cat_key", F.size("tokens").alias("na"), F.col("letters").alias("sa"), F.explode("tokens").alias("token"))
    c = cands.select("cid", "cat_key", F.size("tokens").alias("nb"), F.col("letters").alias("sb"), F.explode("tokens").alias("token"))
    met = n.join(c, ["cat_key", "token"]).groupBy("nid", "cid").agg(
        F.count(F.lit(1)).cast("int").alias("k"), F.sum(F.length("token")).alias("si"),
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    rest_a, rest_b = F.col("na") - F.col("k"), F.col("nb") - F.col("k")
    li = F.col("si") + F.col("k") - 1
    la = F.col("sa") - F.col("si") + F.greatest(rest_a - 1, F.lit(0))
    lb = F.col("sb") - F.col("si") + F.greatest(rest_b - 1, F.lit(0))
    met = met.select("nid", "cid", li.alias("li"), la.alias("la"), lb.alias("lb"), ((rest_a == 0) | (rest_b == 0)).alias("inside"))
    low = F.greatest(200.0 * F.col("li") / (2 * F.col("li") + 1 + F.col("la")), 200.0 * F.col("li") / (2 * F.col("li") + 1 + F.col("lb")))
    most = 200.0 * (F.col("li") + 1 + F.least("la", "lb")) / (2 * F.col("li") + 2 + F.col("la") + F.col("lb"))
    return met.select("nid", "cid", "li", "la", "lb", F.when(F.col("inside"), 100.0).otherwise(low).alias("low"),
                      F.when(F.col("inside"), 100.0).otherwise(F.greatest(low, most)).alias("high"))


def _exact(pairs: DataFrame, names: DataFrame, cands: DataFrame) -> DataFrame:
    """(nid, cid, score) of pairs with a common token whose rests are not empty."""
    rests = (pairs.join(names.select("nid", F.col("tokens").alias("ta")), "nid").join(cands.select("cid", F.col("tokens").alias("tb")), "cid")
             .select("nid", "cid", "li", "la", "lb", "low", F.array_join(F.array_except("ta", "tb"), " ").alias("ra"),
                     F.array_join(F.array_except("tb", "ta"), " ").alias("rb")))
    full = 200.0 * (F.col("li") + 1 + lcs_len("ra", "rb")) / (2 * F.col("li") + 2 + F.col("la") + F.col("lb"))
    return rests.select("nid", "cid", F.greatest("low", full).alias("score"))


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("nid").agg(F.min_by(F.struct("cid", "score"), F.struct(-F.col("score"), F.col("cid"))).alias("b")).select(
        "nid", F.col("b.cid").alias("cid"), F.col("b.score").alias("score"))


def _bag(text: Column) -> Column:
    """Characters with their number of occurrence: a multiset as a set."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))


def token_set_best(names: DataFrame, cands: DataFrame, thresholds: tuple = THRESHOLDS, stats: dict | None = None,
                   few: int = FEW) -> DataFrame:
    """``(nid, candidate, score)``: the candidate of the name's category with
    the highest token-set ratio, 0..100 (ties: lower ``cand_ord``).

    ``names``: (nid, cat_key, a), ``cands``: (cat_key, cand_ord, candidate, b),
    with ``a``/``b`` prepared texts; ``cand_ord`` is unique.  Every name of a
    category with candidates gets a row.  ``stats``, when given, receives the
    number of exact scores in categories of more than ``few`` candidates."""
    small, large, any_large = split_categories(cands.select("cat_key", "cand_ord", "candidate", "b"), few)
    score = token_set_ratio(F.col("a"), F.col("b")).alias("score")
    best = _best(names.join(small, "cat_key").select("nid", F.col("cand_ord").alias("cid"), score))
    if any_large:
        large = cut_lineage(large)
        best = best.unionByName(_bounded_best(names.join(large.select("cat_key").distinct(), "cat_key", "left_semi"), large, thresholds, stats))
    return best.join(cands.select(F.col("cand_ord").alias("cid"), "candidate"), "cid").select("nid", "candidate", "score")


def _bounded_best(names: DataFrame, cands: DataFrame, thresholds: tuple, stats: dict | None) -> DataFrame:
    """(nid, cid, score) by bounds."""
    n = cut_lineage(_sized(names, "nid", "a"))
    c = cut_lineage(_sized(cands.select("cat_key", F.col("cand_ord").alias("cid"), "b"), "cid", "b"))
    scored_count = []

    def count(df: DataFrame) -> DataFrame:
        if stats is not None:
            scored_count.append(df.count())
        return df

    # a name without tokens, or without a common character, scores 0 with all: the first candidate
    first = c.groupBy("cat_key").agg(F.min("cid").alias("cid"))
    best = n.select("nid", "cat_key").join(first, "cat_key").select("nid", "cid", F.lit(0.0).alias("score"))
    live_n, live_c = n.where(F.size("tokens") > 0), c.where(F.size("tokens") > 0)

    # 1. pairs with a common token
    shared = cut_lineage(shared_pairs(live_n, live_c))
    known = shared.where(F.col("low") >= F.col("high")).select("nid", "cid", F.col("low").alias("score"))
    rank = F.row_number().over(Window.partitionBy("nid").orderBy(F.desc("high"), F.desc("low"), "cid"))
    floor = shared.groupBy("nid").agg(F.max("low").alias("floor"))
    open_ = (shared.where(F.col("low") < F.col("high")).join(floor, "nid").where(F.col("high") >= F.col("floor") - _EPS))
    ranked = cut_lineage(open_.withColumn("rank", rank))
    one = cut_lineage(_exact(count(ranked.where(F.col("rank") <= FIRST)), live_n, live_c))
    best = cut_lineage(_best(best.unionByName(known).unionByName(one)))
    more = ranked.where(F.col("rank") > FIRST).join(best.select("nid", F.col("score").alias("now")), "nid").where(F.col("high") >= F.col("now") - _EPS)
    best = cut_lineage(_best(best.unionByName(_exact(count(more), live_n, live_c))))

    # 2. pairs without one, at falling thresholds
    done = shared.select("nid", "cid")
    sorted_c = live_c.select("cat_key", F.col("cid").alias("sid"), F.array_join("tokens", " ").alias("s"))
    open_n = live_n.join(best.where(F.col("score") < 100.0).select("nid"), "nid", "left_semi")
    for t in thresholds:
        left = open_n.select("cat_key", F.col("nid").alias("sid"), F.array_join("tokens", " ").alias("s"))
        found = cut_lineage(similar_pairs(left, sorted_c, t, by="cat_key").select(F.col("lid").alias("nid"), F.col("rid").alias("cid"), "score")
                            .join(done, ["nid", "cid"], "left_anti"))
        best = cut_lineage(_best(best.unionByName(count(found))))
        open_n = cut_lineage(open_n.join(best.where(F.col("score") < t).select("nid"), "nid", "left_semi"))
        if not open_n.limit(1).count():
            break
    else:
        # 3. what is still open, against its whole category
        a = open_n.select("nid", "cat_key", F.array_join("tokens", " ").alias("x")).withColumn("bx", _bag(F.col("x")))
        b = live_c.select("cid", "cat_key", F.array_join("tokens", " ").alias("y")).withColumn("by", _bag(F.col("y")))
        bound = 200.0 * F.size(F.array_intersect("bx", "by")) / (F.length("x") + F.length("y"))
        pairs = (a.join(b, "cat_key").select("nid", "cid", "x", "y", bound.alias("high"))
                 .join(best.select("nid", F.col("score").alias("now")), "nid").where((F.col("high") > 0) & (F.col("high") >= F.col("now") - _EPS))
                 .join(done, ["nid", "cid"], "left_anti"))
        ranked = cut_lineage(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("nid").orderBy(F.desc("high"), "cid"))))
        for part in (F.col("rank") <= FIRST, F.col("rank") > FIRST):
            reached = best.select("nid", F.col("score").alias("reached"))
            todo = ranked.where(part).join(reached, "nid").where(F.col("high") >= F.col("reached") - _EPS)
            best = cut_lineage(_best(best.unionByName(count(todo).select("nid", "cid", indel_ratio("x", "y").alias("score")))))
    if stats is not None:
        stats["exact"] = sum(scored_count)
    return best
