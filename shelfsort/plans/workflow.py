"""Workflows (F1–F5, F8) over the snapshot label store, plus model and
index persistence (S7, S8).

Every step reads one snapshot and writes the next, so a retried job never
sees its own half-written output.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MACHINE_SOURCES, TagConfig
from ..operators import boosting
from ..operators import labels as L
from ..operators.model import METRICS_SCHEMA, CategoryModel, train_metrics
from ..operators.tfidf import TfidfIndex
from ..session import cut_lineage, dense_positions
from ..sources.store import LabelStore, _fs, read_batch_csv, write_batch_csv, write_index_meta_json
from .state import TagState, build_state
from .tagging import batch_output, stored_predictions, tag_batch_results


def _training_frame(labels: DataFrame) -> DataFrame:
    t = L.training_rows(labels).where(F.col("product_name").isNotNull() & F.col("category").isNotNull())
    return t.select(F.col("seq").alias("rid"), F.col("product_name").alias("text"),
                    F.col("category").alias("label"), F.col("seq").alias("ord"))


def train_and_refresh(spark: SparkSession, labels: DataFrame, cfg: TagConfig = TagConfig(),
                      with_cv: bool = True, store: LabelStore | None = None,
                      version: int | None = None) -> tuple[TagState, DataFrame]:
    """W2 → classifier (M3, M6, M8) → rebuilt keys and index.
    Returns the new state and a one-row metrics frame.  With ``store``, model
    (S8) and index (S7) are saved under the label ``version`` they were made
    from, and the metrics row is kept beside them (M8)."""
    train = _training_frame(labels)
    if train.limit(1).count() == 0:
        return build_state(labels, cfg, with_index=False), spark.createDataFrame(
            [("no_data", None, None, None, None)], METRICS_SCHEMA)
    model, metrics = train_metrics(spark, train, cfg.model_c, cfg.model_max_iter,
                                   cfg.model_max_features, with_cv=with_cv, kind=cfg.classifier, boost=cfg.boost)
    state = build_state(labels, cfg, model=model)
    if store is not None:
        save_state(state, metrics, store, version if version is not None else store.versions()[-1])
    return state, metrics


def bootstrap(spark: SparkSession, store: LabelStore, seeds: DataFrame,
              cfg: TagConfig = TagConfig(), with_cv: bool = True) -> tuple[TagState, DataFrame]:
    """insert seeds (U1), save a snapshot, train and refresh."""
    labels = L.seed_insert(store.load(), seeds)
    v = store.save_as_is(labels)
    state, metrics = train_and_refresh(spark, store.load(v), cfg, with_cv, store, v)
    return state, metrics.withColumn("seeded", F.lit(seeds.count()).cast("long"))


def new_samples(labels: DataFrame) -> int:
    """A5: machine-labelled rows (a scalar)."""
    return labels.where(F.col("source").isin(*MACHINE_SOURCES)).count()


def maybe_retrain(spark: SparkSession, labels: DataFrame, cfg: TagConfig = TagConfig(),
                  state: TagState | None = None, store: LabelStore | None = None,
                  version: int | None = None) -> tuple[TagState | None, DataFrame]:
    """retrain when at least ``retrain_min_samples`` machine rows exist;
    ``no_data`` on an empty table."""
    schema = "status string, new_samples long, threshold long"
    if labels.limit(1).count() == 0:
        return state, spark.createDataFrame([("no_data", None, None)], schema)
    n = new_samples(labels)
    if n >= cfg.retrain_min_samples:
        return train_and_refresh(spark, labels, cfg, store=store, version=version)
    return state, spark.createDataFrame([("skipped", n, cfg.retrain_min_samples)], schema)


def force_retrain(spark: SparkSession, labels: DataFrame, cfg: TagConfig = TagConfig(),
                  store: LabelStore | None = None, version: int | None = None):
    """F4."""
    return train_and_refresh(spark, labels, cfg, store=store, version=version)


def correct_and_retrain(spark: SparkSession, store: LabelStore, corrections: DataFrame,
                        cfg: TagConfig = TagConfig(), with_cv: bool = True):
    """apply a table of corrections (U3), save, retrain."""
    labels = L.merge_corrections(store.load(), corrections)
    v = store.save_as_is(labels)
    state, metrics = train_and_refresh(spark, store.load(v), cfg, with_cv, store, v)
    return state, metrics.withColumn("correction_applied", F.lit(True))


def tag_batch(spark: SparkSession, input_path: str, output_path: str, store: LabelStore, cfg: TagConfig = TagConfig(),
              store_results: bool = True, retrain: bool = False, replies: DataFrame | None = None,
              sub_replies: DataFrame | None = None, state: TagState | None = None) -> DataFrame:
    """F7 in one call: a batch CSV (S4) through in-batch reuse and both chains
    (J6, F6, J16), written as a review CSV in file order (P6, S5); its
    predictions are merged into the label table as the next snapshot (U2),
    unless ``store_results`` is off.  ``retrain`` applies the retrain rule (F3)
    afterwards.  The batch is tagged against the newest snapshot and the latest
    training, or ``state``.  Returns the written rows."""
    labels = store.load()
    own = state is None
    state = state or load_state(spark, store, cfg)
    try:
        batch = cut_lineage(read_batch_csv(spark, input_path))
        results = cut_lineage(tag_batch_results(batch, state, cfg, replies=replies, sub_replies=sub_replies))
        out = batch_output(batch, results, cfg)
        write_batch_csv(out, output_path)
        if store_results:
            version = store.save_as_is(L.merge_predictions(labels, stored_predictions(results)))
            if retrain:
                fresh, _ = maybe_retrain(spark, store.load(version), cfg, store=store, version=version)
                if fresh is not None:
                    fresh.release()
    finally:
        if own:
            state.release()
    return out


def ranked(counts: DataFrame, key: str) -> DataFrame:
    """O3 as a column: ``place`` of each row by (n desc, ``key``), from 1."""
    return dense_positions(counts, [F.desc("n"), key], "place").withColumn("place", F.col("place") + 1)


def stats_report(labels: DataFrame) -> dict[str, DataFrame]:
    """F8: table statistics (A1), source counts (A2), category distribution (A3)."""
    return {
        "stats": labels.agg(F.count(F.lit(1)).alias("total_rows"),
                            F.countDistinct("category").alias("unique_categories"),
                            F.coalesce(F.sum(F.col("corrected").cast("long")), F.lit(0)).alias("human_corrections")),
        "sources": labels.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source"),
        "categories": labels.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category"),
    }


# ------------------------------------------------------------ persistence

def save_state(state: TagState, metrics: DataFrame, store: LabelStore, version: int) -> None:
    """Model, index and metrics made from label ``version``, in a folder of
    their own; the metrics row is written last and commits the rest.  A version
    that is already committed stays as it is, so a replay never touches files
    that a session may be reading."""
    spark = store.spark
    if version in _trained(spark, store):
        return
    root = f"{store.root}/_trained/v{version:06d}_{uuid.uuid4().hex}"
    if state.model is not None:
        save_model(state.model, f"{root}/model")
    if state.index is not None:
        save_index(state.index, f"{root}/index")
    metrics.withColumn("version", F.lit(version).cast("long")).write.parquet(f"{root}/metrics")


def _trained(spark: SparkSession, store: LabelStore) -> dict[int, str]:
    """Folder of each committed training, by label version (of two that ran at
    once, the one whose name comes first)."""
    fs, p = _fs(spark, f"{store.root}/_trained")
    if not fs.exists(p):
        return {}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = sorted((st.getPath().toString() for st in fs.listStatus(p) if fs.exists(path(st.getPath(), "metrics/_SUCCESS"))), reverse=True)
    return {int(f.rsplit("/", 1)[1][1:].split("_")[0]): f for f in found}


def metrics_table(spark: SparkSession, store: LabelStore) -> DataFrame:
    """M8: the metrics row of every training, by label version."""
    paths = [f"{root}/metrics" for root in _trained(spark, store).values()]
    schema = METRICS_SCHEMA + ", version long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_state(spark: SparkSession, store: LabelStore, cfg: TagConfig = TagConfig(),
               version: int | None = None) -> TagState:
    """State of a label version (newest by default) with the model and index
    of the latest training at or before it; an index that was never saved is
    built.  As in the original tool, keys and candidates follow the current
    table, model and index the last refresh."""
    vs = store.versions()
    version = version if version is not None else (vs[-1] if vs else None)
    labels = store.load(version)
    model = index = None
    trained = _trained(spark, store)
    for v in sorted((v for v in trained if version is not None and v <= version), reverse=True):
        root = trained[v]
        fs, p = _fs(spark, f"{root}/model/meta")
        model = load_model(spark, f"{root}/model") if fs.exists(p) else None
        fs, p = _fs(spark, f"{root}/index/meta")
        index = load_index(spark, f"{root}/index") if fs.exists(p) and cfg.use_vector else None
        break
    return build_state(labels, cfg, model=model, index=index)


def save_model(model: CategoryModel, path: str) -> None:
    """Classifier, feature vocabulary and class list under one folder."""
    spark = model.vocab.sparkSession
    meta = {"classes": model.classes, "n_features": model.n_features, "kind": model.kind}
    if model.kind == "boosted":
        boosting.forest_table(spark, model.forest).write.mode("overwrite").parquet(f"{path}/forest")
        model.edges.write.mode("overwrite").parquet(f"{path}/edges")
        meta["boost"] = asdict(model.boost)
    else:
        model.lr.write().overwrite().save(f"{path}/lr")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> CategoryModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    vocab = spark.read.parquet(f"{path}/vocab")
    if meta.get("kind") == "boosted":
        return CategoryModel(vocab=vocab, n_features=meta["n_features"], classes=meta["classes"], lr=None,
                             forest=boosting.forest_of(spark.read.parquet(f"{path}/forest")),
                             edges=spark.read.parquet(f"{path}/edges"), boost=boosting.BoostParams(**meta["boost"]))
    return CategoryModel(vocab=vocab, n_features=meta["n_features"], classes=meta["classes"], lr=LogisticRegressionModel.load(f"{path}/lr"))


def save_index(index: TfidfIndex, path: str) -> None:
    """Vocabulary, postings and meta (meta also as JSON lines)."""
    index.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.meta.write.mode("overwrite").parquet(f"{path}/meta")
    write_index_meta_json(index.meta.select("product_name", "predicted_sub_category", "category", "doc_id"),
                          f"{path}/meta_json")


def load_index(spark: SparkSession, path: str) -> TfidfIndex:
    meta = spark.read.parquet(f"{path}/meta")
    return TfidfIndex(vocab=spark.read.parquet(f"{path}/vocab"),
                      postings=spark.read.parquet(f"{path}/postings"), meta=meta, n_docs=meta.count())
