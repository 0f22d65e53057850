"""Registered workloads over the driver's tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose work
grows with the input tables.  Adapters (all derived by Spark from the
tables, whole texts, no sampling):

* ``names``: product names from ``part`` — ``p_name`` followed by one of
  the 29 fixture names (chosen by ``p_partkey % 29``); every third part is
  the fixture name alone.
* ``catalogue_labels``: the 9 seed rows plus one seed row per distinct
  ``p_name`` (category = its noun, capitalised).
* ``doc_labels``: ``documents`` as a label table — whole text as
  ``product_name``, ``lang`` as category, ``source`` column as
  sub-category, one of 8 sources by ``doc_id % 8``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import DEFAULT_SEEDS, LABEL_COLUMNS, TagConfig
from .functions.fuzz import indel_ratio, token_set_ratio
from .functions.text import (category_hint, char_wb_grams, clean_name, norm_key,
                             sort_tokens, strip_generic, strip_ws)
from .operators import labels as L
from .operators.keyword import keyword_best
from .operators.llm import merge_category_replies, request_table, sub_request_table
from .operators.tfidf import (doc_grams, fit_index, gram_stats, gram_texts, in_corpus_best,
                              most_frequent, vector_match, vector_topk)
from .operators.tokenset import token_set_best
from .plans.category import categorize, exact_lookup, fuzzy_match, prepare
from .plans.state import build_state, index_docs
from .plans.subcategory import pair_id, token_set_candidates
from .plans.tagging import batch_output, tag, tag_batch_results
from .plans.workflow import new_samples, ranked, stats_report
from .session import cut_lineage, spread

# Test input names (FIXTURES §4), in fixture order.
FIXTURE_NAMES = (
    "Corona Extra Lager Can 12 x 330ml", "Heineken 0.0 Non-Alcoholic Beer", "Heineken 0.0% Beer",
    "Heineken 0.0%abv", "Non-alcoholic Beer", "alcohol-free ale", "White Claw Hard Seltzer 6pk",
    "White Claw Hard Seltzers", "Angry Orchard Hard Cider Beer", "Cider Vinegar", "Strongbow Cider",
    "Energy Drinks", "Kombucha hard", "Jack Daniel's Tennessee Whiskey", "BeatBox Wine Cocktail",
    "Smirnoff Vodka", "Ready to Drink", "rosé 750ml", "Quilmes Cristal Light", "Heineken Draught",
    "Caft Beer", "Beck's Beer 4 Pack", "Hard Seltzers 12 pack", "Variety Pack", "Ready Drink",
    "Flavoured Hard Beverages", "Seltzers", "Angry Orchard Crisp Light", "Hazy IPA Limited Edition",
)
SOURCES8 = ("seed", "human", "llm", "batch_cache", "vector", "fuzzy", "ml", "keyword")
SUB_CATEGORIES3 = ("Beer", "Hard Beverage", "Non-alcoholic Beer")

CFG = TagConfig()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


# ---------------------------------------------------------------- adapters

def names(spark, d) -> DataFrame:
    fx = spark.createDataFrame(list(enumerate(FIXTURE_NAMES)), "k long, fixture string")
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    j = part.join(F.broadcast(fx), F.col("p_partkey") % 29 == F.col("k"))
    return j.select(F.col("p_partkey").alias("row_id"),
                    F.when(F.col("p_partkey") % 3 == 0, F.col("fixture"))
                    .otherwise(F.concat_ws(" ", "p_name", "fixture")).alias("product_name"))


def _seed_rows(spark) -> DataFrame:
    return spark.createDataFrame([(s, c, i) for i, (s, c) in enumerate(DEFAULT_SEEDS)],
                                 "sub_category string, category string, ord long")


def catalogue_labels(spark, d) -> DataFrame:
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    cat = part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.col("p_name").alias("sub_category"),
        F.initcap(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("category"),
        (F.col("k") + 100).alias("ord"))
    return L.seed_insert(L.empty_labels(spark), _seed_rows(spark).unionByName(cat))


def doc_labels(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select(
        F.col("text").alias("product_name"), F.col("source").alias("predicted_sub_category"),
        F.col("lang").alias("category"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES8]), (F.col("doc_id") % 8 + 1).cast("int")).alias("source"),
        (F.col("n_chars") / 20000.0).alias("confidence"),
        ((F.col("doc_id") % 100) / 100.0).alias("sub_confidence"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        (F.col("doc_id") % 5 == 0).alias("corrected"), F.col("doc_id").alias("seq"))


_OUT = ["product_name", "predicted_sub_category", "category", "source",
        "confidence", "sub_confidence", "corrected"]


def _after_documents(spark, d) -> int:
    """First number past every ``doc_id`` (one scalar): passages are numbered
    behind the documents, at any scale."""
    return _t(spark, d, "documents").agg(F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).first()[0]


# ------------------------------------------------------------ text layers

def q_hint_gate(spark, d):
    """T1 + J2: hint and the hint accepted as a known (seed) category."""
    n = names(spark, d)
    known = spark.createDataFrame([(c,) for c in sorted({c for _, c in DEFAULT_SEEDS})], "kw string")
    h = n.select("row_id", "product_name", category_hint(strip_ws("product_name")).alias("hint"))
    return h.join(F.broadcast(known), h["hint"] == known["kw"], "left").select(
        "row_id", "hint", F.col("kw").alias("keyword_category"))


def q_clean_lookup(spark, d):
    """Cleaned lookup text and its key."""
    n = names(spark, d)
    lk = clean_name(strip_ws("product_name"))
    return n.select("row_id", lk.alias("lookup"), norm_key(lk).alias("lookup_key"))


# ----------------------------------------------------------- label table

def q_dedup_priority(spark, d):
    """W1 + O1 on the document label table."""
    out = L.dedup_priority(doc_labels(spark, d).withColumn("kept_seq", F.col("seq")))
    return out.select(*_OUT, "kept_seq")


def q_dedup_training(spark, d):
    """W2."""
    t = L.training_rows(doc_labels(spark, d))
    return t.select("product_name", "category", "source", F.col("seq").alias("kept_seq"),
                    F.col("train_ord._pri2").alias("train_priority"))


def q_lookup_keys(spark, d):
    """Lower key → category (later wins), position of first appearance."""
    k = L.lookup_keys(L.training_rows(doc_labels(spark, d)))
    return k.select("key", "category", F.col("key_ord._pri2").alias("key_priority"),
                    F.col("key_ord.seq").alias("key_seq"))


def q_coerce_rename(spark, d):
    """P1 + P2: a legacy all-string label table parsed back."""
    docs = _t(spark, d, "documents")
    raw = docs.select(
        F.col("text").alias("sub_category"), F.col("source").alias("predicted_sub_category"),
        F.col("lang").alias("category"), F.lit("ml").alias("source"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("n/a"))
        .otherwise(F.concat(F.col("n_chars").cast("string"), F.lit("e-4"))).alias("confidence"),
        F.concat(F.lit("0."), (F.col("doc_id") % 10).cast("string")).alias("sub_confidence"),
        F.element_at(F.array(F.lit("True"), F.lit("False"), F.lit("maybe")),
                     (F.col("doc_id") % 3 + 1).cast("int")).alias("corrected"),
        F.col("doc_id"))
    return L.coerce_legacy(raw, keep=["doc_id"]).select(
        "doc_id", "product_name", "confidence", "sub_confidence", "corrected")


def q_seed_insert(spark, d):
    """Part names as seed records into the document label table."""
    part = _t(spark, d, "part")
    seeds = part.select(
        F.element_at(F.array(F.upper("p_name"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")),
                             F.col("p_name")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("sub_category"),
        F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"))
    return L.seed_insert(doc_labels(spark, d), seeds).select(*_OUT)


def _predictions(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select(
        F.col("text").alias("product_name"), F.concat(F.col("lang"), F.lit("-v2")).alias("category"),
        F.lit("ml").alias("source"), F.lit(0.5).alias("confidence"),
        F.col("source").alias("predicted_sub_category"), F.lit(0.6).alias("sub_confidence"),
        F.col("doc_id").alias("ord"))
    bench = _t(spark, d, "benchmark").select(
        F.col("text").alias("product_name"), F.lit("bench").alias("category"),
        F.lit("llm").alias("source"), F.lit(0.7).alias("confidence"),
        F.lit("b").alias("predicted_sub_category"), F.lit(0.8).alias("sub_confidence"),
        (F.col("item_id") + _after_documents(spark, d)).alias("ord"))
    return docs.unionByName(bench)


def q_prediction_merge(spark, d):
    """Documents re-predicted (updates) and benchmark passages (inserts)."""
    return L.merge_predictions(doc_labels(spark, d), _predictions(spark, d)).select(*_OUT)


def _corrections(spark, d) -> DataFrame:
    lab = _t(spark, d, "labels")
    docs = _t(spark, d, "documents")
    c1 = docs.join(lab, "doc_id").select(
        F.col("text").alias("product_name"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("category"),
        F.col("doc_id").alias("ord"))
    c2 = _t(spark, d, "benchmark").select(F.col("text").alias("product_name"),
                                          F.lit("passage").alias("category"),
                                          (F.col("item_id") + _after_documents(spark, d)).alias("ord"))
    return c1.unionByName(c2)


def q_correction_merge(spark, d):
    """Labelled documents corrected (updates), passages inserted."""
    return L.merge_corrections(doc_labels(spark, d), _corrections(spark, d)).select(*_OUT)


def q_table_stats(spark, d):
    """A1."""
    return stats_report(doc_labels(spark, d))["stats"]


def q_source_counts(spark, d):
    """A2 + O3: rows per source with their place in the report's order."""
    return ranked(stats_report(doc_labels(spark, d))["sources"], "source")


def q_category_dist(spark, d):
    """A3 + O3."""
    return ranked(stats_report(doc_labels(spark, d))["categories"], "category")


def q_known_categories(spark, d):
    """A4: sorted distinct categories of the label table."""
    return L.known_categories(doc_labels(spark, d))


def q_new_samples(spark, d):
    """A5: machine-labelled rows vs the retrain threshold (F3's decision)."""
    n = new_samples(doc_labels(spark, d))
    return spark.createDataFrame([(n, CFG.retrain_min_samples, n >= CFG.retrain_min_samples)],
                                 "new_samples long, threshold int, retrain boolean")


def q_class_counts(spark, d):
    """Rows per class of the training rows, smallest class, folds."""
    from .operators.model import class_counts
    c = class_counts(L.training_rows(doc_labels(spark, d)).withColumnRenamed("category", "label"))
    k, m = c.agg(F.count(F.lit(1)), F.min("n")).first()   # two scalars
    return c.select("label", "n", F.lit(k).alias("n_classes"), F.lit(m).alias("min_count"),
                    F.lit(None if m is None else min(5, m)).alias("cv_folds"))


def q_exact_lookup(spark, d):
    """Documents (half with a size suffix) and passages looked up in
    the document label table by raw and by cleaned key."""
    docs = _t(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("row_id"),
                    F.when(F.col("doc_id") % 2 == 0, F.col("text"))
                    .otherwise(F.concat(F.col("text"), F.lit(" 12 x 330ml"))).alias("product_name"))
    q = q.unionByName(_t(spark, d, "benchmark").select(
        (F.col("item_id") + _after_documents(spark, d)).alias("row_id"), F.col("text").alias("product_name")))
    state_keys = L.lookup_keys(L.training_rows(doc_labels(spark, d)))

    class _S:  # the exact layer reads only the keys
        keys = state_keys
    u = q.select("row_id", strip_ws("product_name").alias("name"))
    ex = exact_lookup(prepare(u, CFG), _S)
    return u.join(ex, "name").select("row_id", F.col("exact_cat").alias("exact_category"))


# ------------------------------------------------------------- TF-IDF

def q_char_grams(spark, d):
    """T5: char_wb 2–4-gram counts of whole benchmark passages."""
    b = _t(spark, d, "benchmark")
    return doc_grams(b, ["item_id"], "text")


def q_vocabulary(spark, d):
    """The index vocabulary (20,000 most frequent grams) of documents."""
    docs = _t(spark, d, "documents")
    return most_frequent(gram_stats(gram_texts(docs, ["doc_id"], "text"), ["doc_id"]), CFG.index_max_features)


def q_tfidf_weights(spark, d):
    """Sublinear TF-IDF weights of benchmark passages (fit on them)."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"),
                                         F.col("item_id").alias("doc_ord"), "text")
    idx = fit_index(b, "text", None)
    return idx.postings.select(F.col("doc_id").alias("item_id"), "gram",
                               F.round("w", 6).alias("weight"))


def brand_catalogue(spark, d) -> DataFrame:
    """Seeds plus one seed row per distinct ``p_name p_brand`` (category =
    the noun of ``p_name``, sub-category = ``p_name``)."""
    part = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    cat = (part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("sub_category"))
           .agg(F.min("p_partkey").alias("k"), F.first("p_name").alias("p_name"))
           .select("sub_category",
                   F.initcap(F.split_part(F.col("sub_category"), F.lit(" "), F.lit(2))).alias("category"),
                   (F.col("k") + 100).alias("ord")))
    return L.seed_insert(L.empty_labels(spark), _seed_rows(spark).unionByName(cat))


def _name_index(spark, d):
    train = L.training_rows(brand_catalogue(spark, d))
    return fit_index(index_docs(train), "text", CFG.index_max_features, CFG.broadcast_max_rows)


def _name_queries(spark, d):
    n = names(spark, d).select(strip_ws("product_name").alias("name")).distinct()
    return n.select(F.col("name").alias("qid"), clean_name("name").alias("text"))


def q_vector_match(spark, d):
    """names' lookup texts against the brand-catalogue index (cosine ≥ 0.80)."""
    idx = _name_index(spark, d)
    hits = vector_match(_name_queries(spark, d), "text", idx, CFG.vector_threshold)
    n = names(spark, d).select("row_id", strip_ws("product_name").alias("qid"))
    return n.join(hits, "qid").join(idx.meta.select("doc_id", "category", "predicted_sub_category"), "doc_id").select(
        "row_id", "category", F.col("predicted_sub_category").alias("matched"), F.round("score", 6).alias("score"))


def q_vector_topk(spark, d):
    """5 nearest catalogue rows per distinct name."""
    idx = _name_index(spark, d)
    top = vector_topk(_name_queries(spark, d), "text", idx, CFG.vector_top_k)
    return top.join(idx.meta.select("doc_id", "predicted_sub_category"), "doc_id").select(
        F.col("qid").alias("name"), "rank", F.col("predicted_sub_category").alias("matched"),
        F.round("score", 6).alias("score"))


# -------------------------------------------------------------- fuzzy

def q_token_sort(spark, d):
    """Token-sort ratio of each name's lookup against its part name."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name", "p_type")
    n = names(spark, d).join(part, "row_id")
    return n.select("row_id", F.round(indel_ratio(sort_tokens(F.lower(clean_name("product_name"))),
                                                  sort_tokens(F.lower(F.concat_ws(" ", "p_type", "p_name")))),
                                      6).alias("ratio"))


def q_token_set(spark, d):
    """T7 + T8: token-set ratio of generic-stripped lower names vs part names."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    n = names(spark, d).join(part, "row_id")
    return n.select("row_id", F.round(token_set_ratio(F.lower(strip_generic("product_name")),
                                                      F.lower(strip_generic(F.concat_ws(" ", "p_name", F.lit("beer"))))),
                                      6).alias("ratio"))


def q_fuzzy_match(spark, d):
    """names' lookups against the catalogue keys (ratio ≥ 85)."""
    st = build_state(catalogue_labels(spark, d), TagConfig(use_ml=False), with_index=False)
    n = names(spark, d).select("row_id", strip_ws("product_name").alias("name"))
    u = prepare(n, CFG)
    fz = fuzzy_match(u, st, CFG)
    return n.join(fz, "name").select("row_id", F.col("fz_cat").alias("category"),
                                     F.round("fz_score", 6).alias("score"))


def q_near_dup_leaders(spark, d):
    """In-batch leaders/followers over the names in part order."""
    from .operators.neardup import leaders
    n = names(spark, d).select("row_id", strip_ws("product_name").alias("name"))
    firsts = n.groupBy("name").agg(F.min("row_id").alias("ord"))
    return leaders(firsts, CFG.batch_cache_threshold).select("ord", "leader_ord", F.round("score", 6).alias("score"))


# -------------------------------------------------------- sub-category

def _sub_pairs(spark, d) -> DataFrame:
    n = names(spark, d)
    return n.select("row_id", strip_ws("product_name").alias("name"),
                    F.element_at(F.array(*[F.lit(c) for c in SUB_CATEGORIES3]),
                                 (F.col("row_id") % 3 + 1).cast("int")).alias("category"))


def _cands(spark, d):
    return L.sub_candidates(catalogue_labels(spark, d))


def _distinct_pairs(p: DataFrame) -> DataFrame:
    """(nid, name, category, cat_key) of the distinct pairs of ``p``."""
    return (p.select("name", "category").distinct()
            .select(pair_id("name", "category").alias("nid"), "name", "category", F.lower("category").alias("cat_key")))


def q_sub_keyword(spark, d):
    """J8 (+P8, W4, T9): best keyword candidate per (name, category)."""
    p = _sub_pairs(spark, d)
    best = keyword_best(_distinct_pairs(p), cut_lineage(_cands(spark, d)), CFG.style_aliases)
    return p.withColumn("nid", pair_id("name", "category")).join(best, "nid").select(
        "row_id", F.col("candidate").alias("sub_category"), F.col("kws").alias("score"))


def q_sub_fuzzy(spark, d):
    """Best token-set candidate (argmax kept) per distinct (name,
    category), joined back to the rows."""
    p = _sub_pairs(spark, d)
    u = _distinct_pairs(p).withColumn("a", F.lower(strip_generic(clean_name("name"))))
    best = token_set_best(u, token_set_candidates(cut_lineage(_cands(spark, d))))
    return p.withColumn("nid", pair_id("name", "category")).join(best, "nid").select(
        "row_id", F.col("candidate").alias("sub_category"), F.round(F.col("score") / 100.0, 6).alias("score"))


def _brand_pairs(spark, d) -> DataFrame:
    """Every part's name with the noun of its ``p_name`` as category."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("category"))
    return names(spark, d).join(part, "row_id").select("row_id", strip_ws("product_name").alias("name"), "category")


def q_sub_keyword_brands(spark, d):
    """J8 in categories of many candidates: all names against the brand catalogue."""
    p = _brand_pairs(spark, d)
    best = keyword_best(_distinct_pairs(p), cut_lineage(L.sub_candidates(brand_catalogue(spark, d))), CFG.style_aliases)
    return p.withColumn("nid", pair_id("name", "category")).join(best, "nid").select(
        "row_id", F.col("candidate").alias("sub_category"), F.col("kws").alias("score"))


def q_sub_fuzzy_brands(spark, d):
    """J9 in categories of many candidates."""
    p = _brand_pairs(spark, d)
    u = _distinct_pairs(p).withColumn("a", F.lower(strip_generic(clean_name("name"))))
    best = token_set_best(u, token_set_candidates(cut_lineage(L.sub_candidates(brand_catalogue(spark, d)))))
    return p.withColumn("nid", pair_id("name", "category")).join(best, "nid").select(
        "row_id", F.col("candidate").alias("sub_category"), F.round(F.col("score") / 100.0, 6).alias("score"))


def q_sub_vector(spark, d):
    """TF-IDF fitted on the category's candidates plus the query."""
    p = _sub_pairs(spark, d)
    u = p.select("name", "category").distinct()
    q = u.select(F.concat_ws("\u0001", "name", "category").alias("qid"),
                 F.lower("category").alias("grp"), clean_name("name").alias("text"))
    c = _cands(spark, d)
    corpus = c.select(F.col("cat_key").alias("grp"), F.col("cand_ord").alias("doc_id"),
                      F.col("cand_ord").alias("doc_ord"), F.col("candidate").alias("text"))
    best = in_corpus_best(q, corpus).join(corpus.select("doc_id", F.col("text").alias("sub_category")), "doc_id")
    res = p.withColumn("qid", F.concat_ws("\u0001", "name", "category")).join(best, "qid")
    return res.select("row_id", "sub_category", F.round("score", 6).alias("score"))


def q_dataset_sim(spark, d):
    """Most similar reliable row of the category (≥ 2 rows), raw name."""
    p = _sub_pairs(spark, d)
    st = build_state(catalogue_labels(spark, d), TagConfig(use_ml=False), with_index=False)
    u = p.select("name", "category").distinct()
    q = u.select(F.concat_ws("\u0001", "name", "category").alias("qid"),
                 F.lower("category").alias("grp"), F.col("name").alias("text"))
    best = in_corpus_best(q, st.reliable.select("grp", "doc_id", "doc_ord", "text"), min_docs=2)
    best = best.join(st.reliable.select("doc_id", F.col("sub").alias("sub_category")), "doc_id")
    res = p.withColumn("qid", F.concat_ws("\u0001", "name", "category")).join(best, "qid")
    return res.select("row_id", "sub_category", F.round("score", 6).alias("score"))


# ------------------------------------------------------- whole plans

def _plain_cfg():
    return TagConfig(use_ml=False)


def q_tag_names(spark, d):
    """F6 + J13–J16: every name through both layer chains (model and
    reviewer off), catalogue label table."""
    cfg = _plain_cfg()
    st = build_state(catalogue_labels(spark, d), cfg)
    r = tag(names(spark, d), st, cfg)
    return r.select("row_id", "category", F.round("confidence", 6).alias("confidence"), "source",
                    "predicted_sub_category", F.round("sub_confidence", 6).alias("sub_confidence"),
                    "sub_source", "low_confidence", F.array_join("steps_tried", ",").alias("steps"))


def q_batch_tag(spark, d):
    """batch output (D5) with in-batch reuse and review flag."""
    cfg = _plain_cfg()
    st = build_state(catalogue_labels(spark, d), cfg)
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("brand"))
    batch = names(spark, d).join(part, "row_id")
    res = tag_batch_results(batch, st, cfg)
    return batch_output(batch, res, cfg)


def q_review_counts(spark, d):
    """A10: rows needing review per category source."""
    out = q_batch_tag(spark, d)
    return out.groupBy("needs_review", "category_source").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- model

def _doc_train(spark, d):
    t = L.training_rows(doc_labels(spark, d))
    return t.select(F.col("seq").alias("rid"), F.col("product_name").alias("text"),
                    F.col("category").alias("label"), F.col("seq").alias("ord"))


def q_model_train(spark, d):
    """M1–M3, M6, M8: train on document rows → language; metrics row."""
    from .operators.model import train_metrics
    _, metrics = train_metrics(spark, _doc_train(spark, d), CFG.model_c, CFG.model_max_iter, CFG.model_max_features)
    return metrics.select("status", "samples", F.array_join("classes", ",").alias("classes"))


def q_model_score(spark, d):
    """M4, M5, M7: score every conversation turn."""
    from .operators.model import fit, predict
    m = fit(_doc_train(spark, d), CFG.model_c, CFG.model_max_iter, CFG.model_max_features)
    q = _t(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), "text")
    p = predict(m, q)
    return p.select("rid", "ml_category", (F.col("ml_confidence") >= CFG.ml_threshold).alias("confident"))


# --------------------------------------------------------- reviewer

def _catalogue_state(spark, d, cfg=None):
    return build_state(catalogue_labels(spark, d), cfg or _plain_cfg(), with_index=False)


def q_llm_requests(spark, d):
    """L1 + T11: reviewer requests for every distinct name."""
    st = _catalogue_state(spark, d)
    n = names(spark, d).select(strip_ws("product_name").alias("name")).distinct()
    r = request_table(n, st)
    return r.select("request_id", "product_name", F.col("messages")[0]["content"].alias("system_prompt"),
                    F.col("messages")[1]["content"].alias("user_prompt"))


def _answered(spark, d) -> DataFrame:
    """``(row_id, name, event_id, event_type)``: every event with a part's name."""
    parts = _t(spark, d, "part").count()
    ev = _t(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % F.lit(parts)).alias("k"))
    n = names(spark, d).select("row_id", strip_ws("product_name").alias("name"), (F.col("row_id") % F.lit(parts)).alias("k"))
    return ev.join(n, "k").drop("k")


def _replies(spark, d) -> DataFrame:
    """Replies derived from all ``events``: event e answers the part whose key
    leaves the same remainder by the number of parts."""
    j = _answered(spark, d)
    conf = F.concat(F.lit("0."), (F.col("event_id") % 10).cast("string"))
    reply = (F.when(F.col("event_type") == "view",
                    F.concat(F.lit('Sure: {"category": "beer", "confidence": '), conf, F.lit("} ok")))
             .when(F.col("event_type") == "click", F.lit('{"category": "Hard Beverages"}'))
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit('{"category": " Ring ", "confidence": '), conf, F.lit("}")))
             .when(F.col("event_type") == "error", F.lit("no idea"))
             .otherwise(F.concat(F.lit('{"category": "'), F.col("event_type"), F.lit('", "confidence": "high"}'))))
    return j.select(F.sha2(F.col("name"), 256).alias("request_id"), "event_id", reply.alias("reply"))


def q_llm_replies(spark, d):
    """L2 + T10 + J12: replies parsed, canonicalised, joined back (first
    reply per request id)."""
    st = _catalogue_state(spark, d)
    rep = _replies(spark, d)
    first = rep.groupBy("request_id").agg(F.min_by("reply", "event_id").alias("reply"))
    n = names(spark, d).select(strip_ws("product_name").alias("name")).distinct()
    m = merge_category_replies(n, first, st)
    return m.select(F.sha2("name", 256).alias("request_id"), "llm_cat", F.round("llm_conf", 6).alias("llm_conf"))


def q_sub_requests(spark, d):
    """L1 (sub-category) + T11 with the category's candidates."""
    st = _catalogue_state(spark, d)
    p = _sub_pairs(spark, d).select("name", "category").distinct()
    r = sub_request_table(p, st)
    return r.select("request_id", "product_name", "category",
                    F.col("messages")[1]["content"].alias("user_prompt"))


def q_stats_report(spark, d):
    """F8: the report's three tables on the catalogue after seeding, as rows."""
    r = stats_report(catalogue_labels(spark, d))
    st = r["stats"].select(F.expr("stack(3, 'total_rows', total_rows, 'unique_categories', unique_categories, "
                                  "'human_corrections', human_corrections) AS (key, n)"))
    none = F.lit(None).cast("long")
    return (st.select(F.lit("stats").alias("part"), "key", "n", none.alias("place"))
            .unionByName(ranked(r["sources"], "source").select(F.lit("sources").alias("part"), F.col("source").alias("key"), "n", "place"))
            .unionByName(ranked(r["categories"], "category").select(F.lit("categories").alias("part"), F.col("category").alias("key"), "n", "place")))


QUERIES = {
    "hint_gate": q_hint_gate,
    "clean_lookup": q_clean_lookup,
    "dedup_priority": q_dedup_priority,
    "dedup_training": q_dedup_training,
    "lookup_keys": q_lookup_keys,
    "coerce_rename": q_coerce_rename,
    "seed_insert": q_seed_insert,
    "prediction_merge": q_prediction_merge,
    "correction_merge": q_correction_merge,
    "table_stats": q_table_stats,
    "source_counts": q_source_counts,
    "category_dist": q_category_dist,
    "known_categories": q_known_categories,
    "new_samples": q_new_samples,
    "class_counts": q_class_counts,
    "exact_lookup": q_exact_lookup,
    "char_grams": q_char_grams,
    "vocabulary": q_vocabulary,
    "tfidf_weights": q_tfidf_weights,
    "vector_match": q_vector_match,
    "vector_topk": q_vector_topk,
    "token_sort": q_token_sort,
    "token_set": q_token_set,
    "fuzzy_match": q_fuzzy_match,
    "near_dup_leaders": q_near_dup_leaders,
    "sub_keyword": q_sub_keyword,
    "sub_fuzzy": q_sub_fuzzy,
    "sub_keyword_brands": q_sub_keyword_brands,
    "sub_fuzzy_brands": q_sub_fuzzy_brands,
    "sub_vector": q_sub_vector,
    "dataset_sim": q_dataset_sim,
    "tag_names": q_tag_names,
    "batch_tag": q_batch_tag,
    "review_counts": q_review_counts,
    "model_train": q_model_train,
    "model_score": q_model_score,
    "llm_requests": q_llm_requests,
    "llm_replies": q_llm_replies,
    "sub_requests": q_sub_requests,
    "stats_report": q_stats_report,
}


# ------------------------------------------------- workflows and stream

def _scratch(spark, tag: str) -> str:
    import uuid
    from .session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/work-{tag}-{uuid.uuid4().hex[:8]}"


def q_bootstrap_retrain(spark, d):
    """F1 + F2: seed the catalogue into an empty store, train, refresh."""
    from .plans.workflow import bootstrap
    from .sources.store import LabelStore
    store = LabelStore(spark, _scratch(spark, "boot"))
    part = _t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    seeds = _seed_rows(spark).unionByName(part.select(
        F.col("p_name").alias("sub_category"),
        F.initcap(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("category"),
        (F.col("k") + 100).alias("ord")))
    _, metrics = bootstrap(spark, store, seeds, TagConfig())
    return metrics.select("status", "samples", "seeded", F.size("classes").alias("n_classes"))


def q_correct_retrain(spark, d):
    """U3 + F5: corrections from ``labels`` applied to the catalogue store."""
    from .plans.workflow import correct_and_retrain
    from .sources.store import LabelStore
    store = LabelStore(spark, _scratch(spark, "corr"))
    store.save_as_is(catalogue_labels(spark, d))
    n = names(spark, d).join(_t(spark, d, "labels").withColumnRenamed("doc_id", "row_id"), "row_id")
    corr = n.select(strip_ws("product_name").alias("product_name"),
                    F.when(F.col("quality") == 1, "Beer").otherwise("Hard Beverage").alias("category"),
                    F.col("row_id").alias("ord"))
    _, metrics = correct_and_retrain(spark, store, corr, TagConfig())
    return metrics.select("status", "samples", "correction_applied")


def q_stream_tag(spark, d):
    """Names arrive as CSV files; the stream tags each micro-batch,
    writes output and merges predictions into the snapshot store."""
    from .sources.store import LabelStore
    from .streaming.incremental import start
    root = _scratch(spark, "stream")
    n = names(spark, d)
    (n.select("row_id", "product_name").repartition(2, "row_id")
     .write.option("header", True).csv(f"{root}/in"))
    store = LabelStore(spark, f"{root}/labels")
    store.save_as_is(catalogue_labels(spark, d))
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("product_name", T.StringType())])
    q = start(spark, f"{root}/in", schema, store, f"{root}/out", f"{root}/ckpt", TagConfig(use_ml=False),
              order_col="row_id")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        F.col("row_id").cast("long").alias("row_id"), "predicted_category", "predicted_sub_category",
        "category_source", "needs_review")


QUERIES.update({
    "bootstrap_retrain": q_bootstrap_retrain,
    "correct_retrain": q_correct_retrain,
    "stream_tag": q_stream_tag,
})


def _hint_train(spark, d) -> DataFrame:
    """Distinct names labelled by their keyword hint, in first-appearance order."""
    n = names(spark, d).select("row_id", strip_ws("product_name").alias("name"))
    u = n.groupBy("name").agg(F.min("row_id").alias("ord"))
    return (u.select(F.col("ord").alias("rid"), F.col("name").alias("text"),
                     category_hint("name").alias("label"), "ord")
            .where(F.col("label").isNotNull()))


def q_cv_folds(spark, d):
    """M6: unshuffled stratified fold of every training row (k = min(5,
    smallest class))."""
    from .operators.model import class_counts, stratified_folds
    t = _hint_train(spark, d)
    k = min(5, int(class_counts(t).agg(F.min("n")).first()[0]))
    return stratified_folds(t, k).select("rid", "label", "fold")


def q_model_cv(spark, d):
    """M6 + A9: cross-validated accuracy of the classifier on hint labels."""
    from .operators.model import cross_validate
    acc = cross_validate(_hint_train(spark, d), CFG.model_c, CFG.model_max_iter, CFG.model_max_features)
    return spark.createDataFrame([(acc,)], "cv_accuracy double")


QUERIES.update({"cv_folds": q_cv_folds, "model_cv": q_model_cv})


# ------------------------------------------------ adapters and round trips

def q_label_store(spark, d):
    """S1 + S6: the document label table saved and read back."""
    from .sources.store import LabelStore
    store = LabelStore(spark, _scratch(spark, "store"))
    store.save(doc_labels(spark, d))
    return store.load().select(*_OUT, "seq")


def q_batch_csv(spark, d):
    """S4 + S5: documents (whole texts, with quotes and line feeds) through
    the batch CSV writer, reader and writer again."""
    from .sources.store import read_batch_csv, write_batch_csv
    root = _scratch(spark, "csv")
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("product_name"), "lang")
    write_batch_csv(docs.withColumn("row_id", F.col("doc_id")), f"{root}/a")
    once = read_batch_csv(spark, f"{root}/a")
    write_batch_csv(once, f"{root}/b")
    return read_batch_csv(spark, f"{root}/b").select(F.col("doc_id").cast("long").alias("doc_id"), "product_name", "lang")


def q_seed_json(spark, d):
    """Seed records of all parts, written as JSON arrays of 200 records, a
    file each, and read back."""
    from .sources.store import read_seed_json
    path = _scratch(spark, "seeds")
    part = _t(spark, d, "part").select(F.floor(F.col("p_partkey") / 200).alias("chunk"), F.struct(
        F.concat_ws(" ", "p_name", F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).alias("sub_category"), F.col("p_type").alias("category")).alias("seed"))
    (part.groupBy("chunk").agg(F.to_json(F.collect_list("seed")).alias("value"))
     .write.partitionBy("chunk").option("lineSep", "\n").text(path))
    return read_seed_json(spark, f"{path}/chunk=*").select("sub_category", "category")


def q_index_store(spark, d):
    """Weights of the benchmark index after saving and loading it."""
    from .plans.workflow import load_index, save_index
    b = _t(spark, d, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("item_id").alias("doc_ord"), "text",
        F.lit("passage").alias("category"), F.lit("passage").alias("predicted_sub_category"))
    path = _scratch(spark, "index")
    save_index(fit_index(b, "text", None), path)
    return load_index(spark, path).postings.select(F.col("doc_id").alias("item_id"), "gram", F.round("w", 6).alias("weight"))


def q_model_store(spark, d):
    """S8 + M7: predictions of the saved and loaded model equal the model's own."""
    from .operators.model import fit, predict
    from .plans.workflow import load_model, save_model
    t = _hint_train(spark, d)
    m = fit(t, CFG.model_c, CFG.model_max_iter, CFG.model_max_features)
    path = _scratch(spark, "model")
    save_model(m, path)
    a, b = predict(m, t), predict(load_model(spark, path), t)
    return a.join(b.toDF("rid", "c", "p"), "rid").select(
        "rid", ((F.col("ml_category") == F.col("c")) & (F.abs(F.col("ml_confidence") - F.col("p")) < 1e-9)).alias("same"))


def q_model_quality(spark, d):
    """Trained on four fifths of the documents, each classifier
    beats the majority class on the others, and its probabilities are in (0, 1]."""
    from .operators.model import fit, predict
    t = cut_lineage(_doc_train(spark, d))
    held = t.where(F.col("rid") % 5 == 0)
    major = held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).first()[0]   # one scalar
    out = None
    for kind in ("linear", "boosted"):
        m = fit(t.where(F.col("rid") % 5 != 0), CFG.model_c, CFG.model_max_iter, CFG.model_max_features, kind, CFG.boost)
        p = predict(m, held.select("rid", "text")).join(held.select("rid", "label"), "rid")
        right = F.avg((F.col("ml_category") == F.col("label")).cast("double"))
        row = p.agg(F.lit(kind).alias("classifier"), F.count(F.lit(1)).alias("n"), (right > F.lit(major)).alias("better_than_majority"),
                    F.min((F.col("ml_confidence") > 0) & (F.col("ml_confidence") <= 1.0 + 1e-9)).alias("probable"))
        out = row if out is None else out.unionByName(row)
    return out


def q_sub_replies(spark, d):
    """L3 + T10: sub-category replies derived from all events, merged."""
    from .operators.llm import merge_sub_replies, request_id
    st = _catalogue_state(spark, d)
    p = _sub_pairs(spark, d)
    reply = (F.when(F.col("event_type") == "view", F.lit('Sure: {"sub_category": "craft BEER"} ok'))
             .when(F.col("event_type") == "click", F.lit('{"sub_category": " New Thing "}'))
             .when(F.col("event_type") == "purchase", F.lit('{"sub_category": null}'))
             .when(F.col("event_type") == "error", F.lit("{'sub_category': 'Craft Beer'}"))
             .otherwise(F.concat(F.lit('{"sub_category": "'), F.col("event_type"), F.lit('"}'))))
    rep = (_answered(spark, d).join(p.select("row_id", "category"), "row_id")
           .select(request_id("name", "category").alias("request_id"), "event_id", reply.alias("reply"))
           .groupBy("request_id").agg(F.min_by("reply", "event_id").alias("reply")))
    pairs = p.select("name", "category").distinct()
    return merge_sub_replies(pairs, rep, st).select(F.sha2(F.concat_ws("\u0001", "name", "category"), 256).alias("request_id"), "llm_sub")


def q_retrain_rule(spark, d):
    """too few machine rows, and an empty table."""
    from .plans.workflow import maybe_retrain
    lb = doc_labels(spark, d)
    out = maybe_retrain(spark, lb, TagConfig(retrain_min_samples=1 << 30))[1]
    return out.unionByName(maybe_retrain(spark, lb.limit(0), CFG)[1])


def q_full_chain(spark, d):
    """F2, F4, M4, M5, L2, J13 with model and replies on: every name, with the
    rules that must hold of its record whatever the model's numbers are."""
    from .plans.workflow import force_retrain
    cfg = TagConfig()
    st, _ = force_retrain(spark, catalogue_labels(spark, d), cfg)
    rep = _replies(spark, d).groupBy("request_id").agg(F.min_by("reply", "event_id").alias("reply"))
    r = tag(names(spark, d), st, cfg, replies=rep)
    c, s = F.col("confidence"), F.col("source")
    steps = F.size("steps_tried")
    return r.select(
        "row_id", s.isin("dataset", "keyword", "fuzzy", "vector").alias("early"),
        ((s != "ml") | (c >= cfg.ml_threshold)).alias("ml_is_confident"),
        ((s != "fallback") | ((c < cfg.ml_threshold) & F.col("low_confidence"))).alias("fallback_is_weak"),
        ((s != "llm") | (F.col("low_confidence") == (c < 0.5))).alias("llm_flag"),
        F.when(s.isin("ml", "llm", "fallback"), F.array_contains("steps_tried", "ml") & (steps >= 4)).otherwise(F.lit(True)).alias("steps_ok"),
        F.col("predicted_sub_category").isNotNull().alias("has_sub"))


QUERIES.update({"label_store": q_label_store, "batch_csv": q_batch_csv, "seed_json": q_seed_json, "index_store": q_index_store, "model_store": q_model_store,
                "model_quality": q_model_quality, "sub_replies": q_sub_replies, "retrain_rule": q_retrain_rule,
                "full_chain": q_full_chain})
