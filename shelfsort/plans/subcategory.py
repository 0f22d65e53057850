"""Sub-category layers in order (J14): exact → keyword → fuzzy → vector →
dataset-similar → reviewer reply → fallback, over the candidate list of the
chosen category.  Works on distinct (name, category) pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TagConfig
from ..functions.text import strip_generic
from ..operators.keyword import keyword_best
from ..operators.llm import merge_sub_replies
from ..operators.tfidf import in_corpus_best
from ..operators.tokenset import token_set_best
from ..session import bounded_broadcast, cut_lineage
from .state import TagState


def pair_id(name, category):
    """One key for a (name, category) pair."""
    return F.concat_ws("\u0001", name, category)


def token_set_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates as J9 compares them."""
    return candidates.select("cat_key", "cand_ord", "candidate", F.lower(strip_generic("candidate")).alias("b"))


def subcategorize(pairs: DataFrame, state: TagState, cfg: TagConfig = TagConfig(),
                  replies: DataFrame | None = None) -> DataFrame:
    """``pairs``: distinct ``(name, lookup, category)``.  Returns ``(name,
    category, predicted_sub_category, sub_confidence, sub_source)``."""
    p = pairs.withColumn("cat_key", F.lower("category"))
    cands = bounded_broadcast(state.candidates, cfg.broadcast_max_rows)
    has = p.join(cands.select("cat_key").distinct(), "cat_key", "left_semi")
    none = p.join(cands.select("cat_key").distinct(), "cat_key", "left_anti").select(
        "name", "category", F.lit("Unknown").alias("predicted_sub_category"),
        F.lit(0.0).alias("sub_confidence"), F.lit("fallback").alias("sub_source"))

    # J7 exact: candidate spelled like the name or the lookup text
    cmap = (state.candidates.groupBy("cat_key", F.lower("candidate").alias("lc"))
            .agg(F.max_by("candidate", "cand_ord").alias("canon")))
    cmap = bounded_broadcast(cmap, cfg.broadcast_max_rows)
    c1 = cmap.select(F.col("cat_key").alias("_k1"), F.col("lc").alias("_l1"), F.col("canon").alias("e1"))
    c2 = cmap.select(F.col("cat_key").alias("_k2"), F.col("lc").alias("_l2"), F.col("canon").alias("e2"))
    e = has.join(c1, (F.col("cat_key") == F.col("_k1")) & (F.lower("name") == F.col("_l1")), "left")
    e = e.join(c2, (F.col("cat_key") == F.col("_k2")) & (F.lower("lookup") == F.col("_l2")), "left")
    e = e.drop("_k1", "_l1", "_k2", "_l2")
    e = e.withColumn("exact_sub", F.coalesce("e1", "e2")).drop("e1", "e2")

    # J8 keyword tiers, for the names without an exact candidate
    e = cut_lineage(e.withColumn("nid", pair_id("name", "category")))
    kw = keyword_best(e.where(F.col("exact_sub").isNull()), state.candidates, cfg.style_aliases)
    e = cut_lineage(e.join(kw.select("nid", F.col("candidate").alias("kw_sub")), "nid", "left"))
    open1 = e.where(F.col("exact_sub").isNull() & F.col("kw_sub").isNull())

    # J9 fuzzy (token-set on generic-stripped, lower-cased text) — argmax kept
    fz = token_set_best(open1.select("nid", "cat_key", F.lower(strip_generic("lookup")).alias("a")), token_set_candidates(state.candidates))
    fz = fz.select("nid", F.col("candidate").alias("fz_sub"), (F.col("score") / 100.0).alias("fz_score"))
    r = cut_lineage(e.join(fz, "nid", "left").drop("nid"))
    open2 = r.where(F.col("exact_sub").isNull() & F.col("kw_sub").isNull()
                    & (F.coalesce(F.col("fz_score"), F.lit(0.0)) < cfg.sub_threshold))

    # J10 vector: TF-IDF fitted on the candidates plus the query
    q = open2.select(pair_id("name", "category").alias("qid"),
                     F.col("cat_key").alias("grp"), F.col("lookup").alias("text"))
    corpus = state.candidates.select(
        F.col("cat_key").alias("grp"), F.col("cand_ord").alias("doc_id"),
        F.col("cand_ord").alias("doc_ord"), F.col("candidate").alias("text"))
    vb = in_corpus_best(q, corpus).join(corpus.select("doc_id", F.col("text").alias("vec_sub")), "doc_id")
    vb = vb.select("qid", "vec_sub", F.col("score").alias("vec_score"))
    r = cut_lineage(r.withColumn("qid", pair_id("name", "category"))
                    .join(vb, "qid", "left"))
    open3 = r.where(F.col("exact_sub").isNull() & F.col("kw_sub").isNull()
                    & (F.coalesce(F.col("fz_score"), F.lit(0.0)) < cfg.sub_threshold)
                    & (F.coalesce(F.col("vec_score"), F.lit(0.0)) < cfg.sub_threshold))

    # J11 dataset-similar: reliable rows of the category (≥ 2), raw name
    q3 = open3.select("qid", F.col("cat_key").alias("grp"), F.col("name").alias("text"))
    ds = in_corpus_best(q3, state.reliable.select("grp", "doc_id", "doc_ord", "text"), min_docs=2)
    ds = ds.join(state.reliable.select("doc_id", F.col("sub").alias("ds_sub")), "doc_id")
    ds = ds.select("qid", "ds_sub", F.col("score").alias("ds_score"))
    in_c = state.candidates.select(F.col("cat_key").alias("_ck"), F.col("candidate").alias("_cand")).distinct()
    r = r.join(ds, "qid", "left")
    r = (r.join(in_c, (r["cat_key"] == in_c["_ck"]) & (r["ds_sub"] == in_c["_cand"]), "left")
         .withColumn("ds_in", F.col("_cand").isNotNull()).drop("_ck", "_cand"))

    if replies is not None:
        open4 = r.where(F.col("exact_sub").isNull() & F.col("kw_sub").isNull()
                        & (F.coalesce(F.col("fz_score"), F.lit(0.0)) < cfg.sub_threshold)
                        & (F.coalesce(F.col("vec_score"), F.lit(0.0)) < cfg.sub_threshold)
                        & ~((F.coalesce(F.col("ds_score"), F.lit(0.0)) >= cfg.sub_threshold) & F.col("ds_in")))
        llm = merge_sub_replies(open4.select("name", "category"), replies, state)
        r = r.join(llm, ["name", "category"], "left")
    else:
        r = r.withColumn("llm_sub", F.lit(None).cast("string"))

    fz_ok = F.col("fz_score") >= cfg.sub_threshold
    vec_ok = F.col("vec_score") >= cfg.sub_threshold
    ds_ok = (F.col("ds_score") >= cfg.sub_threshold) & F.col("ds_in")
    first_cand = F.col("fz_sub")  # present whenever candidates exist
    src = (F.when(F.col("exact_sub").isNotNull(), "exact").when(F.col("kw_sub").isNotNull(), "keyword")
           .when(fz_ok, "fuzzy").when(vec_ok, "vector").when(ds_ok, "dataset_sim")
           .when(F.col("llm_sub").isNotNull(), "llm").otherwise("fallback"))
    sub = (F.when(F.col("exact_sub").isNotNull(), F.col("exact_sub"))
           .when(F.col("kw_sub").isNotNull(), F.col("kw_sub"))
           .when(fz_ok, F.col("fz_sub")).when(vec_ok, F.col("vec_sub")).when(ds_ok, F.col("ds_sub"))
           .when(F.col("llm_sub").isNotNull(), F.col("llm_sub"))
           .when(F.col("ds_in") & F.col("ds_sub").isNotNull(), F.col("ds_sub"))
           .otherwise(first_cand))
    conf = (F.when(F.col("exact_sub").isNotNull(), 1.0)
            .when(F.col("kw_sub").isNotNull(), cfg.sub_keyword_confidence)
            .when(fz_ok, F.col("fz_score")).when(vec_ok, F.col("vec_score")).when(ds_ok, F.col("ds_score"))
            .when(F.col("llm_sub").isNotNull(), cfg.sub_llm_confidence)
            .when(F.col("ds_in") & F.col("ds_sub").isNotNull(), F.col("ds_score"))
            .otherwise(F.coalesce(F.col("fz_score"), F.lit(0.0))))
    out = r.select("name", "category", sub.alias("predicted_sub_category"),
                   conf.cast("double").alias("sub_confidence"), src.alias("sub_source"))
    return out.unionByName(none)
