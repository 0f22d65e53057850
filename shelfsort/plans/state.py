"""One immutable snapshot of everything the layers read (labels, lookup keys,
index, model).  A batch is tagged against one snapshot; see README for how
this differs from a row-by-row loop that re-reads the table per row."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RELIABLE_SOURCES, TagConfig
from ..operators import labels as L
from ..operators.model import CategoryModel
from ..operators.tfidf import TfidfIndex, fit_index


@dataclass
class TagState:
    labels: DataFrame          # LABEL_SCHEMA, table order = seq
    keys: DataFrame            # W3: key, category, key_ord
    known: DataFrame           # A4: category
    first_known: str | None    # sorted first known category (scalar)
    candidates: DataFrame      # P8/W4: cat_key, candidate, cand_ord
    reliable: DataFrame        # P9: grp, doc_id, doc_ord, text, sub
    index: TfidfIndex | None   # J4/J5 over training rows
    model: CategoryModel | None
    cached: tuple = ()         # frames to release

    def release(self) -> None:
        """Give cached frames back (a stream builds a state per batch)."""
        for df in self.cached:
            df.unpersist()


def index_docs(train: DataFrame) -> DataFrame:
    """Index rows = training rows (W2) in training order.  ``doc_id`` is the
    row's ``seq`` — a compact key, since postings repeat it per gram."""
    return train.select(
        F.col("seq").alias("doc_id"),
        F.col("train_ord").alias("doc_ord"),
        F.col("product_name").alias("text"),
        "category", "predicted_sub_category")


def build_state(labels: DataFrame, cfg: TagConfig = TagConfig(),
                model: CategoryModel | None = None, with_index: bool = True,
                index: TfidfIndex | None = None) -> TagState:
    lv = StorageLevel.MEMORY_AND_DISK
    labels = labels.persist(lv)
    train = L.training_rows(labels).persist(lv)
    keys = L.lookup_keys(train).persist(lv)
    known = L.known_categories(labels).persist(lv)
    first = known.agg(F.min("category")).first()[0]
    cands = L.sub_candidates(labels).persist(lv)
    rel = labels.where(
        F.col("source").isin(*RELIABLE_SOURCES) & F.col("category").isNotNull()
        & F.col("predicted_sub_category").isNotNull() & (F.col("predicted_sub_category") != "")
        & F.col("product_name").isNotNull())
    rel = (rel.withColumn("grp", F.lower("category"))
           .groupBy("grp", "product_name")
           .agg(F.min_by(F.struct(F.col("seq").alias("doc_ord"),
                                  F.col("predicted_sub_category").alias("sub")), "seq").alias("r"))
           .select("grp", F.col("r.doc_ord").alias("doc_id"),
                   "r.doc_ord", F.col("product_name").alias("text"), "r.sub"))
    if index is None and with_index and cfg.use_vector:
        index = fit_index(index_docs(train), "text", cfg.index_max_features, cfg.broadcast_max_rows)
    return TagState(labels=labels, keys=keys, known=known, first_known=first,
                    candidates=cands, reliable=rel, index=index, model=model,
                    cached=(labels, train, keys, known, cands))
