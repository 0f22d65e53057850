"""Stages of the corpus pipeline: each applies one operator to all rows of its
input and lets its decisions take effect.

Filtering stages drop rows by id or row number.  The table of dropped numbers is
broadcast when it is counted and found small enough, so texts do not move;
beyond that it is a shuffle join.  Null ids are matched like values.  Columns,
their names and their order stay as they came.

The exact, near-duplicate and decontamination stages decide by row, so rows
without an id, and rows that repeat one, are judged by their own texts.  The
latter two number the rows once, in a written copy of their input.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsort.llm.common import WHITE_SPACE, fresh, materialise, store, table
from shelfsort.session import ensure_checkpoint_dir, ship_package

BROADCAST_IDS = 1_000_000  # at most 8 MB of ids


def drop_documents(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped`` (first column)."""
    k = fresh(docs, "dropped_id")
    dropped = materialise(dropped.select(F.col(dropped.columns[0]).cast("bigint").alias(k)).distinct())
    right = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(right, F.col(doc_id).cast("bigint").eqNullSafe(F.col(k)), "left_anti")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written copy of ``docs`` with a column of row numbers, and its name."""
    k = fresh(docs, "row_number")
    return store(docs.withColumn(k, F.monotonically_increasing_id()), "numbered"), k


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.  It is trained on the
    labels and texts of the stage's own input."""
    from shelfsort.llm.toxicity import THRESHOLD, score, train
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < THRESHOLD).drop(scored.columns[-1])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest,
    then the one of the smallest doc_id."""
    from shelfsort.llm.exact_dedup import exact_dedup
    rows = materialise(exact_dedup(docs))
    by_id = materialise(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any_kept")))
    left = drop_documents(docs, by_id.where("not any_kept").select("doc_id"))
    repeated = by_id.where("n > 1 and any_kept").select("doc_id")
    if repeated.limit(1).count() == 0:
        return left
    # Rows that share an id are told apart by their text.
    k, d = fresh(docs, "kept_id"), fresh(docs, "kept_digest")
    kept = rows.where("kept").join(repeated.withColumnRenamed("doc_id", "r"), F.col("doc_id").eqNullSafe(F.col("r"))).select(
        F.col("doc_id").alias(k), F.col("text_sha256").alias(d), "n_points").withColumnRenamed("n_points", fresh(docs, "kept_points"))
    p = kept.columns[2]
    r = fresh(docs, "repeated_id")
    again = repeated.select(F.col("doc_id").cast("bigint").alias(r))
    same_id = F.col("doc_id").cast("bigint").eqNullSafe(F.col(r))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.translate(text, WHITE_SPACE, ""), 256)
    one = (docs.join(again, same_id, "left_semi")
           .join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col(k)) & (digest == F.col(d)) & (F.char_length(text) == F.col(p)))
           .dropDuplicates([k, d]).select(*docs.columns))
    return left.join(again, same_id, "left_anti").unionByName(one)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id, a
    null one last."""
    from shelfsort.llm.ngram_join import jaccard_components
    rows, k = numbered(docs)
    found = jaccard_components(rows, doc_id=k).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    ids = rows.select(F.col(k).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    named = materialise(found.join(ids, "row"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    dropped = named.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return drop_documents(rows, dropped, k).drop(k)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    from shelfsort.llm.decontaminate import decontaminate
    rows, k = numbered(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), doc_id=k)
    return drop_documents(rows, found.where("contaminated").select("doc_id"), k).drop(k)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents replicated to the target weights, in global random order."""
    from shelfsort.llm.mixing import mix
    return mix(docs)


def _ready(stage):
    """Any stage may be the first call of a session."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, _ready(stage)) for name, stage in (
    ("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("ngram_jaccard_join", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage), ("mixing", mixing_stage))]
