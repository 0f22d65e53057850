"""J8 and J9 as joins, against every (name, candidate) pair in plain Python."""
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfsort.config import SUB_SKIP_WORDS, TagConfig
from shelfsort.functions.fuzz import token_set_ratio_py
from shelfsort.operators.keyword import keyword_best, prefix_pairs
from shelfsort.operators.tokenset import token_set_best

ALIASES = TagConfig().style_aliases


def keyword_score_py(name, candidate):
    nl, cl = name.lower(), candidate.lower()
    if cl in nl:
        return 100 + len(cl)
    hits = [a for a in ALIASES.get(candidate, ()) if re.search(rf"\b{re.escape(a)}\b", nl)]
    if hits:
        return 90 + max(map(len, hits))
    nw = [w for w in re.findall("[a-z]+", nl) if len(w) >= 4]
    met = [w for w in re.findall("[a-z]+", cl) if len(w) >= 4 and w not in SUB_SKIP_WORDS
           and any(x.startswith(w[:5]) or w.startswith(x[:5]) for x in nw)]
    return 10 * len(met) + sum(map(len, met))


WORDS = ["Craft", "Beer", "light", "Lager", "lagers", "IPA", "hazy", "pale", "Pack", "Variety", "variet", "hard", "Seltzer", "selt",
         "a", "of", "rosé", "Crème", "cider", "Ciders", "x9", "é", "b", "craft-beer", "Flavored", "flavour", "Punch"]


def _sides(spark, seed, n_names, n_cands):
    r = random.Random(seed)
    names = sorted({(" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 6))), f"c{r.randrange(3)}") for _ in range(n_names)})
    cands = sorted({(f"c{r.randrange(3)}", " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 4)))) for _ in range(n_cands)})
    cands += [("c0", k) for k in ALIASES] + [("c1", "e"), ("c1", "ra"), ("c2", "Hard Seltzers")]
    cands = sorted(set(cands))
    r.shuffle(cands)
    nd = spark.createDataFrame([(i, c, t) for i, (t, c) in enumerate(names)], "nid long, cat_key string, name string")
    cd = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(cands)], "cat_key string, candidate string, cand_ord long")
    return names, cands, nd, cd


@pytest.mark.parametrize("few", [0, 30, 1000])
def test_keyword_tiers_equal_all_pairs(spark, few):
    names, cands, nd, cd = _sides(spark, 1, 400, 80)
    got = {r.nid: (r.candidate, r.kws) for r in keyword_best(nd, cd, ALIASES, few).collect()}
    for i, (name, cat) in enumerate(names):
        scores = [(keyword_score_py(name, c), -k, c) for k, (g, c) in enumerate(cands) if g == cat]
        best = max(scores)
        assert got.get(i) == ((best[2], best[0]) if best[0] > 0 else None), (name, cat)


def test_keyword_tiers_without_candidates_or_aliases(spark):
    _, _, nd, cd = _sides(spark, 2, 10, 5)
    assert keyword_best(nd, cd.where("false"), ALIASES).count() == 0
    assert keyword_best(nd.where("false"), cd, {}).count() == 0


def test_prefix_tier_stays_far_under_the_product(spark):
    """10,000 candidates and 20,000 names of one category."""
    def word(c):
        return F.translate(F.substring(F.md5(c.cast("string")), 1, 7), "0123456789", "ghijklmnop")
    cands = spark.range(10_000).select(F.lit("c").alias("cat_key"), F.col("id").alias("cid"),
                                       F.concat_ws(" ", word(F.col("id") % 3000), word(F.col("id") + 10_000)).alias("cl"))
    names = spark.range(20_000).select(F.col("id").alias("nid"), F.lit("c").alias("cat_key"),
                                       F.concat_ws(" ", word(F.col("id") % 3000), word(F.col("id") + 90_000)).alias("nl"))
    assert prefix_pairs(names, cands).count() < 20_000 * 10_000 / 1000


@pytest.mark.parametrize("few,thresholds", [(0, (85.0,)), (0, (85.0, 60.0)), (0, ()), (1000, (85.0,))])
def test_token_set_best_equals_all_pairs(spark, few, thresholds):
    names, cands, nd, cd = _sides(spark, 3, 300, 90)
    n = nd.select("nid", "cat_key", F.lower("name").alias("a"))
    c = cd.select("cat_key", "cand_ord", "candidate", F.lower("candidate").alias("b"))
    got = {r.nid: (r.candidate, round(r.score, 9)) for r in token_set_best(n, c, thresholds, few=few).collect()}
    assert len(got) == len(names)
    for i, (name, cat) in enumerate(names):
        best = max((round(token_set_ratio_py(name.lower(), t.lower()), 9), -k, t) for k, (g, t) in enumerate(cands) if g == cat)
        assert got[i] == (best[2], best[0]), (name, cat)


def test_token_set_scores_few_pairs_exactly(spark):
    """Each name has its candidate with a misspelling or one more word."""
    def word(c):
        return F.translate(F.substring(F.md5(c.cast("string")), 1, 9), "0123456789", "ghijklmnop")
    base = F.concat_ws(" ", word(F.col("id") % 40), word(F.col("id") + 1000), word(F.col("id") + 2000))
    c = spark.range(800).select(F.lit("c").alias("cat_key"), F.col("id").alias("cand_ord"), base.alias("candidate"), base.alias("b"))
    n = spark.range(800).select(F.col("id").alias("nid"), F.lit("c").alias("cat_key"), F.when(F.col("id") % 2 == 0, F.concat(base, F.lit(" new")))
                                .otherwise(F.regexp_replace(base, "a", "b")).alias("a"))
    stats = {}
    out = token_set_best(n, c, stats=stats)
    own = c.select(F.col("cand_ord").alias("nid"), F.col("candidate").alias("own"))
    assert out.join(own, "nid").where(F.col("candidate") == F.col("own")).count() > 780
    assert stats["exact"] < 0.05 * 800 * 800
