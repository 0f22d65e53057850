"""Label-table operators: priority de-duplication (W1–W4), merges (U1–U4),
coercion (P1, P2).

The label table is a DataFrame with ``LABEL_SCHEMA``; ``seq`` is the row's
position in table order (the original system relies on row order for ties).
All operators are set-based: one merge per batch instead of one table
rewrite per stored row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    AUTHORITATIVE_SOURCES, LABEL_COLUMNS, LABEL_SCHEMA, SAVE_PRIORITY,
    SAVE_PRIORITY_OTHER, TRAIN_PRIORITY, TRAIN_PRIORITY_OTHER,
)
from ..functions.text import norm_key, strip_ws
from ..session import dense_positions


def priority_col(priorities: dict, other: int, col: str = "source"):
    """Map a source to its rank; unknown or null sources rank ``other``."""
    m = F.create_map(*[x for k, v in priorities.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col(col)), F.lit(other))


def _first_per(df: DataFrame, keys: list, order) -> DataFrame:
    """First row per key under ``order`` (a column or struct).

    A hash aggregate with ``min_by`` instead of a window: the partial
    (map-side) aggregation collapses a hot key before the shuffle, so one key
    holding a third of all rows does not land whole in one task."""
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*cols), order).alias("_r"))
            .select(*keys, "_r.*"))


def dedup_priority(labels: DataFrame, near: list | None = None) -> DataFrame:
    """W1 + O1: one row per exact ``product_name``, highest save priority
    (ties: earlier row).  ``seq`` is renumbered in (priority, seq) order —
    the table order after every save.  ``near``: columns made from the name
    that ``labels`` already lies by (dropped)."""
    pri = priority_col(SAVE_PRIORITY, SAVE_PRIORITY_OTHER)
    kept = _first_per(labels.withColumn("_pri", pri), [*(near or []), "product_name"],
                      F.struct(F.col("_pri"), F.col("seq"))).drop(*(near or []))
    return renumber(kept, ["_pri", "seq"]).drop("_pri")


def renumber(df: DataFrame, order: list) -> DataFrame:
    """``seq`` = dense position in ``order``.  ``order`` must be total (table
    rows have distinct ``seq``).  The numbered rows are checkpointed, so every
    later use of ``seq`` as an id sees the same numbers (no single-task window)."""
    return dense_positions(df.drop("_new_seq"), order, "_new_seq").withColumn("seq", F.col("_new_seq")).select(*df.columns)


def training_rows(labels: DataFrame) -> DataFrame:
    """One row per exact ``product_name`` under the training priority
    (human, seed, llm first; every other source ties with ml).  Adds
    ``train_ord`` = position in the training order (priority, seq)."""
    pri = priority_col(TRAIN_PRIORITY, TRAIN_PRIORITY_OTHER)
    kept = _first_per(labels.withColumn("_pri2", pri), ["product_name"],
                      F.struct(F.col("_pri2"), F.col("seq")))
    return kept.withColumn("train_ord", F.struct(F.col("_pri2"), F.col("seq"))).drop("_pri2")


def lookup_keys(train: DataFrame) -> DataFrame:
    """lower(name) → category, later duplicate wins; ``key_ord`` keeps the
    position where the key first appeared (dictionary insertion order)."""
    return (
        train.where(F.col("product_name").isNotNull())
        .groupBy(F.lower("product_name").alias("key"))
        .agg(F.max_by("category", "train_ord").alias("category"),
             F.min("train_ord").alias("key_ord"))
    )


def known_categories(labels: DataFrame) -> DataFrame:
    """A4: distinct non-null categories (sorting is applied by consumers)."""
    return labels.where(F.col("category").isNotNull()).select("category").distinct()


def sub_candidates(labels: DataFrame) -> DataFrame:
    """P8 + W4: per lower(category), distinct sub-categories of seed/human rows
    in first-appearance order (``cand_ord``)."""
    rows = labels.where(
        F.col("source").isin(*AUTHORITATIVE_SOURCES)
        & F.col("category").isNotNull()
        & F.col("predicted_sub_category").isNotNull()
        & (F.col("predicted_sub_category") != "")
    ).select(F.lower("category").alias("cat_key"),
             F.col("predicted_sub_category").alias("candidate"), "seq")
    return rows.groupBy("cat_key", "candidate").agg(F.min("seq").alias("cand_ord"))


def coerce_legacy(raw: DataFrame, keep: list | None = None) -> DataFrame:
    """P1 + P2 for a label table read as all strings (CSV import); ``keep``
    lists extra columns passed through unchanged."""
    df = raw
    if "sub_category" in df.columns and "product_name" not in df.columns:
        df = df.withColumnRenamed("sub_category", "product_name")
    return df.select(
        F.col("product_name"),
        F.col("predicted_sub_category"),
        F.col("category"),
        F.col("source"),
        F.expr("try_cast(confidence as double)").alias("confidence"),
        F.expr("try_cast(sub_confidence as double)").alias("sub_confidence"),
        F.when(F.col("corrected") == "True", F.lit(True))
        .when(F.col("corrected") == "False", F.lit(False)).alias("corrected"),
        *(keep or []),
    )


def _label_row(name, sub, category, source, conf, sub_conf, corrected, seq):
    return F.struct(
        name.alias("product_name"), sub.alias("predicted_sub_category"),
        category.alias("category"), source.alias("source"),
        conf.cast("double").alias("confidence"), sub_conf.cast("double").alias("sub_confidence"),
        F.current_timestamp().alias("timestamp"), corrected.alias("corrected"),
        seq.cast("long").alias("seq"),
    )


def seed_insert(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert seed records (``sub_category``, ``category``, ``ord``) whose
    lower name is neither in the table nor earlier in the list.  Returns the
    saved table (W1 applied)."""
    s = seeds.select(strip_ws("sub_category").alias("name"),
                     strip_ws("category").alias("cat"), "ord")
    s = _first_per(s.withColumn("key", F.lower("name")), ["key"], F.col("ord"))
    existing = labels.where(F.col("product_name").isNotNull()).select(F.lower("product_name").alias("key"))
    fresh = s.join(existing, "key", "left_anti")
    base = _next_seq(labels)
    ins = fresh.select(_label_row(
        F.col("name"), F.col("name"), F.col("cat"), F.lit("seed"),
        F.lit(None), F.lit(None), F.lit(False), F.lit(base) + F.col("ord")).alias("r")).select("r.*")
    return dedup_priority(labels.unionByName(ins))


def _next_seq(labels: DataFrame) -> int:
    """First ``seq`` after the table (a scalar; new rows go to the end)."""
    m = labels.agg(F.max("seq")).first()[0]
    return 0 if m is None else int(m) + 1


def _digest(key):
    """A name's key as 32 bytes: rows meet by it, so whole texts do not move as
    keys beside the names themselves."""
    return F.unhex(F.sha2(key, 256))


def _merge_incoming(labels: DataFrame, incoming: DataFrame, skip_authoritative: bool,
                    update_cols: dict, insert_row) -> DataFrame:
    """Shared MERGE: ``incoming`` has ``key``, ``first_name`` and the value
    columns of the last incoming row per key.  Everything meets by ``key``: a
    row's text moves once to the merge and once to its place in the new order."""
    # table side is lower-cased only (stored names are already stripped)
    tab = labels.withColumn("key", _digest(F.lower("product_name")))
    # only keys present in the batch are inspected
    key_info = (tab.select("key", "source").join(incoming.select("key"), "key", "left_semi")
                .groupBy("key")
                .agg(F.max(F.col("source").isin(*AUTHORITATIVE_SOURCES).cast("int")).alias("auth")))
    inc = incoming.join(key_info, "key", "left")
    if skip_authoritative:
        inc = inc.where(F.coalesce(F.col("auth"), F.lit(0)) == 0)
    # update path: every existing row of the key takes the incoming values
    values = inc.where(F.col("auth").isNotNull()).drop("auth", "first_name", "i_ord").withColumn("_hit", F.lit(True))
    upd = tab.join(values, "key", "left")
    hit = F.col("_hit").isNotNull()
    updated = upd.select("key", *[
        (F.when(hit, update_cols[c]).otherwise(F.col(c)) if c in update_cols else F.col(c)).alias(c)
        for c in LABEL_COLUMNS
    ])
    # insert path: keys not in the table, appended after the last row
    base = _next_seq(labels)
    new = inc.where(F.col("auth").isNull()).withColumn("b", F.lit(base))
    inserted = new.select("key", insert_row.alias("r")).select("key", "r.*")
    return dedup_priority(updated.unionByName(inserted), ["key"])


def merge_predictions(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """Store predictions (``product_name``, ``category``, ``source``,
    ``confidence``, ``predicted_sub_category``, ``sub_confidence``, ``ord``).

    Per key lower(strip(name)): a seed/human row makes the key read-only;
    other existing rows are updated in place (name and ``corrected`` kept);
    new keys are inserted.  Within one batch the last row per key supplies
    the values and the first supplies the inserted name, as a row-by-row
    loop would."""
    p = preds.withColumn("key", _digest(norm_key("product_name")))
    w_first = F.min_by(strip_ws("product_name"), "ord")
    inc = p.groupBy("key").agg(
        w_first.alias("first_name"),
        F.max_by(F.struct(
            strip_ws("category").alias("i_category"),
            F.col("source").alias("i_source"),
            F.col("confidence").cast("double").alias("i_conf"),
            strip_ws(F.coalesce("predicted_sub_category", F.lit(""))).alias("i_sub"),
            F.col("sub_confidence").cast("double").alias("i_sub_conf"),
        ), "ord").alias("v"),
        F.min("ord").alias("i_ord"),
    ).select("key", "first_name", "i_ord", "v.*")
    update_cols = {
        "category": F.col("i_category"), "source": F.col("i_source"),
        "confidence": F.col("i_conf"), "predicted_sub_category": F.col("i_sub"),
        "sub_confidence": F.col("i_sub_conf"), "timestamp": F.current_timestamp(),
    }
    insert_row = _label_row(F.col("first_name"), F.col("i_sub"), F.col("i_category"),
                            F.col("i_source"), F.col("i_conf"), F.col("i_sub_conf"),
                            F.lit(False), F.col("b") + F.col("i_ord"))
    return _merge_incoming(labels, inc, True, update_cols, insert_row)


def merge_corrections(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human corrections (``product_name``, ``category``, ``ord``).

    Existing rows of the key get the category, source human, both confidences
    1.0 and corrected=true, keeping their sub-category; unknown names are
    inserted with sub-category = name."""
    p = corrections.withColumn("key", _digest(norm_key("product_name")))
    inc = p.groupBy("key").agg(
        F.min_by(strip_ws("product_name"), "ord").alias("first_name"),
        F.max_by(strip_ws("category"), "ord").alias("i_category"),
        F.min("ord").alias("i_ord"),
    )
    update_cols = {
        "category": F.col("i_category"), "source": F.lit("human"),
        "confidence": F.lit(1.0), "sub_confidence": F.lit(1.0),
        "corrected": F.lit(True), "timestamp": F.current_timestamp(),
    }
    insert_row = _label_row(F.col("first_name"), F.col("first_name"), F.col("i_category"),
                            F.lit("human"), F.lit(1.0), F.lit(1.0), F.lit(True),
                            F.col("b") + F.col("i_ord"))
    return _merge_incoming(labels, inc, False, update_cols, insert_row)


def empty_labels(spark) -> DataFrame:
    return spark.createDataFrame([], LABEL_SCHEMA)
