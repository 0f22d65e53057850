"""Public tagging plans: ``tag`` (F6, J16) and ``tag_batch_results`` with
``batch_output`` (F7, P3–P7); ``workflow.tag_batch`` runs a whole batch job.

Both take and return DataFrames; the work per distinct name is done once
and joined back to the rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BATCH_OUTPUT_COLUMNS, REVIEW_SOURCES, TagConfig
from ..functions.text import clean_name, strip_ws
from ..operators.neardup import leaders
from ..session import bounded_broadcast, cut_lineage
from .category import categorize
from .state import TagState
from .subcategory import subcategorize

STORED_SOURCES = ("keyword", "fuzzy", "vector", "ml", "llm", "batch_cache")


def tag(names: DataFrame, state: TagState, cfg: TagConfig = TagConfig(),
        name_col: str = "product_name", id_col: str = "row_id",
        replies: DataFrame | None = None, sub_replies: DataFrame | None = None) -> DataFrame:
    """F6 + J16: one result record (D4) per input row."""
    rows = names.select(F.col(id_col).alias("row_id"), strip_ws(name_col).alias("name"))
    cat = categorize(rows, state, cfg, replies)
    sub = subcategorize(cat.select("name", "lookup", "category").distinct(), state, cfg, sub_replies)
    res = _per_name(cat.join(sub, ["name", "category"], "left"), cfg)
    return rows.join(res, "name").select(
        "row_id", F.col("name").alias("sub_category"), "category", "confidence", "source",
        "predicted_sub_category", "sub_confidence", "sub_source", "low_confidence", "steps_tried")


def _per_name(res: DataFrame, cfg: TagConfig) -> DataFrame:
    """Materialise per-name results and make the join back to the rows
    skew-proof: a batch may repeat one name for a third of its rows, so the
    result side is broadcast when its row count is proven bounded; above the
    bound the join stays a shuffle and AQE splits the hot partition."""
    return bounded_broadcast(cut_lineage(res), cfg.broadcast_max_rows)


def review_flag(cfg: TagConfig = TagConfig()):
    """YES when a confidence is low or the source needs a look."""
    cond = ((F.col("confidence") < cfg.review_category_threshold)
            | (F.col("sub_confidence") < cfg.review_sub_threshold)
            | F.col("source").isin(*REVIEW_SOURCES))
    return F.when(cond, "YES").otherwise("NO")


def input_column(df: DataFrame) -> str:
    """``sub_category`` if present, else ``product_name``."""
    if "sub_category" in df.columns:
        return "sub_category"
    if "product_name" in df.columns:
        return "product_name"
    raise ValueError("input must have a 'product_name' or 'sub_category' column")


def tag_batch_results(batch: DataFrame, state: TagState, cfg: TagConfig = TagConfig(),
                      id_col: str = "row_id", replies: DataFrame | None = None,
                      sub_replies: DataFrame | None = None) -> DataFrame:
    """F7 core: D4 records per batch row with in-batch reuse.

    Leaders go through the category layers; followers copy their leader's
    category and confidence with source ``batch_cache`` and get their own
    sub-category.  ``batch`` needs ``id_col`` (row order) and the input
    column."""
    col = input_column(batch)
    rows = batch.select(F.col(id_col).alias("row_id"),
                        strip_ws(F.coalesce(F.col(col), F.lit(""))).alias("name"))
    firsts = rows.groupBy("name").agg(F.min("row_id").alias("ord"))
    lead = _per_name(leaders(firsts, cfg.batch_cache_threshold), cfg)
    # rows: the first row of a leader name is a leader; every other row reuses
    r = rows.join(lead, "name")
    is_leader_row = F.col("leader_name").isNull() & (F.col("row_id") == F.col("ord"))
    r = r.withColumn("reuse_from", F.when(is_leader_row, F.lit(None))
                     .otherwise(F.coalesce("leader_name", "name")))
    leader_names = r.where(F.col("reuse_from").isNull()).select("name")
    cat = categorize(leader_names, state, cfg, replies)
    follow = (r.where(F.col("reuse_from").isNotNull()).select("name", "reuse_from").distinct()
              .join(cat.select(F.col("name").alias("reuse_from"), "category", "confidence"), "reuse_from")
              .select("name", clean_name("name").alias("lookup"), "category", "confidence",
                      F.lit("batch_cache").alias("source"), F.lit(False).alias("low_confidence"),
                      F.array(F.lit("batch_cache")).alias("steps_tried")))
    lead_res = cat.select("name", "lookup", "category", "confidence", "source",
                          "low_confidence", "steps_tried")
    pairs = lead_res.select("name", "lookup", "category").unionByName(
        follow.select("name", "lookup", "category")).distinct()
    sub = subcategorize(pairs, state, cfg, sub_replies)
    lead_res = _per_name(lead_res.join(sub, ["name", "category"], "left"), cfg)
    follow = _per_name(follow.join(sub, ["name", "category"], "left"), cfg)
    lead_rows = r.where(F.col("reuse_from").isNull()).select("row_id", "name").join(lead_res, "name")
    foll_rows = r.where(F.col("reuse_from").isNotNull()).select("row_id", "name").join(follow, "name")
    res = lead_rows.unionByName(foll_rows)
    return res.select(
        "row_id", F.col("name").alias("sub_category"), "category", "confidence", "source",
        "predicted_sub_category", "sub_confidence", "sub_source", "low_confidence", "steps_tried")


def batch_output(batch: DataFrame, results: DataFrame, cfg: TagConfig = TagConfig(),
                 id_col: str = "row_id") -> DataFrame:
    """P4, P5, P6 + D5 column order: extra columns, input column, outputs."""
    col = input_column(batch)
    extra = [c for c in batch.columns if c not in (col, id_col)]
    b = batch.select(id_col, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in extra])
    o = results.select(
        F.col("row_id").alias(id_col), F.col("sub_category").alias(col),
        F.col("category").alias("predicted_category"), "predicted_sub_category",
        F.round("confidence", 4).alias("category_confidence"),
        F.round("sub_confidence", 4).alias("sub_category_confidence"),
        F.col("source").alias("category_source"), F.col("sub_source").alias("sub_category_source"),
        review_flag(cfg).alias("needs_review"))
    return b.join(o, id_col).select(id_col, *extra, col, *BATCH_OUTPUT_COLUMNS)


def stored_predictions(results: DataFrame) -> DataFrame:
    """Rows a batch writes back (U2 input): everything except exact-table hits
    and fallbacks, in row order."""
    return results.where(F.col("source").isin(*STORED_SOURCES)).select(
        F.col("sub_category").alias("product_name"), "category", "source", "confidence",
        "predicted_sub_category", "sub_confidence", F.col("row_id").alias("ord"))
