"""String-similarity joins (J3, J6, J12) with lossless blocking.

``similar_pairs`` finds every pair of strings whose Indel ratio is at least
``T`` (0 < T ≤ 100) without comparing all pairs:

* With ``δ = 1 − T/100`` and lengths ``L, l``, ratio ≥ T bounds the Indel
  distance by ``D = (L + l)·δ``; each edit destroys at most two character
  bigrams, so the two bigram multisets share at least
  ``max(L, l) − 1 − 2D`` items.  Minimised over the partner length this is
  ``o(s) = L·(1 − 4δ) − 1`` for a string of length L.
* Standard prefix filtering: order bigram occurrences ``(gram, occurrence)``
  globally rare-first; a string keeps its first ``(L − 1) − ⌈o(s)⌉ + 1``
  items.  Two strings that must share ``≥ o`` items share an item of both
  prefixes — so joining prefixes on the item finds every qualifying pair.
* Strings with ``o(s) ≤ 0`` (at T=85: up to two characters; at T=92: one)
  can only reach T with an identical partner, so they are matched by
  equality.
* Below about T=84 that argument fails and single characters are the items:
  the common subsequence has at least ``T/200·(L + l)`` characters, and a
  partner has at least ``L·T/(200 − T)``, so the character multisets share
  ``≥ o(s) = L·T/(200 − T) > 0`` items.  Exact for every T > 0, less
  selective.

Candidates also obey the length bound ``l ≥ L·T/(200 − T)``.  Survivors are
verified with the exact LCS kernel.  Rare-first order keeps hot items out of
the prefixes; AQE's skew-join split covers the rest.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzz import indel_ratio


def _gram_size(threshold: float) -> tuple[int, int]:
    """(characters per item, length up to which strings match by equality)."""
    if not 0 < threshold <= 100:
        raise ValueError("a similarity threshold must be above 0 and at most 100")
    factor = 1.0 - 4.0 * (1.0 - threshold / 100.0)
    if factor > 0:
        short_max = math.floor(1.0 / factor)   # L with o(s) <= 0
        # equality is exact while no other partner can reach T: 200·L/(2L+1) < T
        if 200.0 * short_max / (2 * short_max + 1) < threshold:
            return 2, short_max
    return 1, 0


def _items(strings: DataFrame, n: int, keys: list) -> DataFrame:
    """``(sid, *keys, L, gram, occ)`` for every occurrence of an n-character gram."""
    grams = strings.select("sid", *keys, "s", F.length("s").alias("L"),
                           F.explode(F.sequence(F.lit(1), F.length("s") - (n - 1))).alias("pos"))
    grams = grams.select("sid", *keys, "L", "pos", F.expr(f"substring(s, pos, {n})").alias("gram"))
    w = Window.partitionBy("sid", "gram").orderBy("pos")
    return grams.withColumn("occ", F.row_number().over(w)).drop("pos")


def prefix_items(strings: DataFrame, threshold: float, order_by: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``(sid, gram, occ)``: the items that a string must be looked up by.
    Two strings with ratio ≥ ``threshold`` share one.  ``order_by``: the
    strings whose item frequencies give the global order (all sides of a join
    must name the same); by default ``strings``.  ``by`` names a column of
    groups that are joined apart; the result carries it."""
    n, short_max = _gram_size(threshold)
    keys = [by] if by else []
    long = F.length("s") > short_max
    items = _items(strings.where(long), n, keys)
    base = items if order_by is None else _items(order_by.where(long), n, keys)
    freq = base.groupBy(*keys, "gram", "occ").agg(F.count(F.lit(1)).alias("freq"))
    it = items.join(freq, [*keys, "gram", "occ"])
    if n == 2:
        need = F.ceil(F.col("L") * (1.0 - 4.0 * (1.0 - threshold / 100.0)) - 1.0 - 1e-9)
    else:
        need = F.ceil(F.col("L") * (threshold / (200.0 - threshold)) - 1e-9)
    plen = (F.col("L") - (n - 1)) - need + 1
    w = Window.partitionBy("sid").orderBy("freq", "gram", "occ")
    kept = it.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= plen).select("sid", *keys, "gram", "occ")
    # occurrence 0 never happens in a text: the key of equality matches
    short = strings.where(~long).select("sid", *keys, F.col("s").alias("gram"), F.lit(0).alias("occ"))
    return kept.unionByName(short)


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(lid, rid, score)`` of the candidate pairs that reach ``threshold``."""
    ratio = threshold / (200.0 - threshold)
    fits = ((F.length("ls") >= F.length("rs") * ratio - 1e-9) & (F.length("rs") >= F.length("ls") * ratio - 1e-9))
    scored = (pairs.join(left.select(F.col("sid").alias("lid"), F.col("s").alias("ls")), "lid")
              .join(right.select(F.col("sid").alias("rid"), F.col("s").alias("rs")), "rid")
              .where(fits).withColumn("score", indel_ratio("ls", "rs")))
    return scored.where(F.col("score") >= threshold).select("lid", "rid", "score")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """All ``(lid, rid, score)`` with Indel ratio(left.s, right.s) ≥ threshold.

    ``left``/``right``: ``(sid, s)`` with prepared strings (e.g. token-sorted);
    with ``by``, only pairs that agree in that column."""
    keys = [by] if by else []
    both = None
    for side, df in (("l", left), ("r", right)):
        part = df.select(F.concat(F.lit(side), F.col("sid").cast("string")).alias("sid"), *keys, "s")
        both = part if both is None else both.unionByName(part)
    lp = prefix_items(left, threshold, both, by).withColumnRenamed("sid", "lid")
    rp = prefix_items(right, threshold, both, by).withColumnRenamed("sid", "rid")
    cand = lp.join(rp, [*keys, "gram", "occ"]).select("lid", "rid").distinct()
    return score_pairs(cand, left, right, threshold)
