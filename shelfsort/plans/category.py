"""Category layers in order (J13): exact → keyword → fuzzy → vector → model →
reviewer reply → fallback.  Each layer only sees names the earlier layers
left open, and every layer works on *distinct* names: a batch with many
repeats of one name does the matching work once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TagConfig
from ..functions.text import category_hint, clean_name, sort_tokens
from ..operators.fuzzy import similar_pairs
from ..operators.llm import merge_category_replies
from ..operators.model import predict as model_predict
from ..operators.tfidf import vector_match
from ..session import bounded_broadcast, cut_lineage
from .state import TagState

_STEPS = {
    "dataset": ["dataset_exact"],
    "keyword": ["dataset_exact"],
    "fuzzy": ["dataset_exact", "fuzzy"],
    "vector": ["dataset_exact", "fuzzy", "vector"],
    "ml": ["dataset_exact", "fuzzy", "vector", "ml"],
    "llm": ["dataset_exact", "fuzzy", "vector", "ml", "llm"],
    "fallback": ["dataset_exact", "fuzzy", "vector", "ml", "llm", "fallback"],
}


def steps_col(source_col: str = "source"):
    m = F.create_map(*[x for k, v in _STEPS.items()
                       for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.element_at(m, F.col(source_col))


def prepare(names: DataFrame, cfg: TagConfig) -> DataFrame:
    """T1–T3 on distinct stripped names: ``(name, hint, lookup)``."""
    return names.select("name").distinct().select(
        "name", category_hint("name", cfg.keyword_rules).alias("hint"),
        clean_name("name").alias("lookup"))


def exact_lookup(u: DataFrame, state: TagState) -> DataFrame:
    """Category of lower(name), else of lower(lookup); adds ``exact_cat``."""
    k = state.keys.select("key", F.col("category").alias("_c"))
    k = k.where(F.col("_c").isNotNull() & (F.col("_c") != ""))
    a = u.join(k.withColumnRenamed("_c", "_c1"), F.lower(u["name"]) == k["key"], "left").drop("key")
    b = a.join(k.withColumnRenamed("_c", "_c2"), F.lower(a["lookup"]) == k["key"], "left").drop("key")
    return b.withColumn("exact_cat", F.coalesce("_c1", "_c2")).drop("_c1", "_c2")


def keyword_gate(u: DataFrame, state: TagState, cfg: TagConfig) -> DataFrame:
    """The hint counts only when it is a known category; adds ``kw_cat``."""
    known = bounded_broadcast(state.known.select(F.col("category").alias("kw_cat")), cfg.broadcast_max_rows)
    return u.join(known, u["hint"] == known["kw_cat"], "left")


def fuzzy_match(open_: DataFrame, state: TagState, cfg: TagConfig) -> DataFrame:
    """Best lookup key by token-sort ratio on lower-cased text, accepted at
    ≥ threshold; ties go to the key that appeared first.
    Returns ``(name, fz_cat, fz_score)`` with score in 0..1."""
    q = open_.select(F.col("name").alias("sid"), sort_tokens(F.lower("lookup")).alias("s"))
    keys = state.keys.select(F.col("key").alias("sid"), sort_tokens("key").alias("s"))
    pairs = similar_pairs(q, keys, cfg.fuzzy_threshold)
    best = (pairs.join(state.keys.select(F.col("key").alias("rid"), "category", "key_ord"), "rid")
            .groupBy("lid").agg(F.min_by(F.struct("category", "score"),
                                         F.struct(-F.col("score"), F.col("key_ord"))).alias("b")))
    return best.select(F.col("lid").alias("name"), F.col("b.category").alias("fz_cat"),
                       (F.col("b.score") / 100.0).alias("fz_score"))


def vector_layer(open_: DataFrame, state: TagState, cfg: TagConfig) -> DataFrame:
    """J4 on the lookup text: ``(name, vec_cat, vec_score)``."""
    q = open_.select(F.col("name").alias("qid"), F.col("lookup").alias("text"))
    hits = vector_match(q, "text", state.index, cfg.vector_threshold, cfg.broadcast_max_rows)
    return (hits.join(state.index.meta.select("doc_id", "category"), "doc_id")
            .select(F.col("qid").alias("name"), F.col("category").alias("vec_cat"),
                    F.col("score").alias("vec_score")))


def categorize(names: DataFrame, state: TagState, cfg: TagConfig = TagConfig(),
               replies: DataFrame | None = None) -> DataFrame:
    """Per distinct stripped ``name``: ``(name, lookup, category, confidence,
    source, low_confidence, steps_tried, ml_category, ml_confidence)``.

    ``replies`` (optional): reviewer/LLM answers ``(request_id, reply)`` for the
    request table of ``llm.request_table``; rows without a usable reply fall
    back.
    """
    u = cut_lineage(keyword_gate(exact_lookup(prepare(names, cfg), state), state, cfg))
    decided = F.col("exact_cat").isNotNull() | F.col("kw_cat").isNotNull()
    res = u
    if cfg.use_fuzzy:
        fz = fuzzy_match(u.where(~decided), state, cfg)
        res = res.join(fz, "name", "left")
    else:
        res = res.withColumn("fz_cat", F.lit(None).cast("string")).withColumn("fz_score", F.lit(None).cast("double"))
    res = cut_lineage(res)
    open2 = res.where(~decided & F.col("fz_cat").isNull())
    if cfg.use_vector and state.index is not None:
        res = res.join(vector_layer(open2, state, cfg), "name", "left")
    else:
        res = res.withColumn("vec_cat", F.lit(None).cast("string")).withColumn("vec_score", F.lit(None).cast("double"))
    res = cut_lineage(res)
    open3 = res.where(~decided & F.col("fz_cat").isNull() & F.col("vec_cat").isNull())
    if cfg.use_ml and state.model is not None:
        ml = model_predict(state.model, open3.select(F.col("name").alias("rid"), F.col("lookup").alias("text")))
        res = cut_lineage(res.join(ml.withColumnRenamed("rid", "name"), "name", "left"))
    else:
        res = res.withColumn("ml_category", F.lit(None).cast("string")).withColumn("ml_confidence", F.lit(None).cast("double"))
    ml_hit = F.col("ml_confidence") >= cfg.ml_threshold
    if replies is not None:
        open4 = res.where(~decided & F.col("fz_cat").isNull() & F.col("vec_cat").isNull() & ~F.coalesce(ml_hit, F.lit(False)))
        llm = merge_category_replies(open4.select("name"), replies, state, cfg)
        res = res.join(llm, "name", "left")
    else:
        res = res.withColumn("llm_cat", F.lit(None).cast("string")).withColumn("llm_conf", F.lit(None).cast("double"))

    first = F.lit(state.first_known) if state.first_known is not None else F.lit("Unknown")
    source = (F.when(F.col("exact_cat").isNotNull(), "dataset")
              .when(F.col("kw_cat").isNotNull(), "keyword")
              .when(F.col("fz_cat").isNotNull(), "fuzzy")
              .when(F.col("vec_cat").isNotNull(), "vector")
              .when(ml_hit, "ml")
              .when(F.col("llm_cat").isNotNull(), "llm")
              .otherwise("fallback"))
    category = F.coalesce(
        "exact_cat", "kw_cat", "fz_cat", "vec_cat",
        F.when(ml_hit, F.col("ml_category")), "llm_cat", "ml_category", first)
    conf = (F.when(F.col("exact_cat").isNotNull(), 1.0)
            .when(F.col("kw_cat").isNotNull(), cfg.keyword_confidence)
            .when(F.col("fz_cat").isNotNull(), F.col("fz_score"))
            .when(F.col("vec_cat").isNotNull(), F.col("vec_score"))
            .when(ml_hit, F.col("ml_confidence"))
            .when(F.col("llm_cat").isNotNull(), F.col("llm_conf"))
            .when(F.col("ml_category").isNotNull(), F.col("ml_confidence"))
            .otherwise(0.0))
    out = res.select("name", "lookup", source.alias("source"), category.alias("category"),
                     conf.cast("double").alias("confidence"), "ml_category", "ml_confidence", "llm_conf")
    low = (F.when(F.col("source") == "fallback", True)
           .when(F.col("source") == "llm", F.col("llm_conf") < 0.5)
           .otherwise(False))
    return out.select("name", "lookup", "category", "confidence", "source",
                      low.alias("low_confidence"), steps_col().alias("steps_tried"),
                      "ml_category", "ml_confidence")
