"""Incremental tagging with Structured Streaming.

New CSV files land in an input folder; each micro-batch is tagged against
one label snapshot (F7), its output rows are written under
``<out>/batch_id=<n>`` (overwritten on retry, so a replayed batch never
duplicates rows), its predictions are merged into the label table as the
next snapshot (U2), and the retrain rule (F3) runs after the merge.

Exactly-once, also after a crash at any point:

* before a batch is tagged, the snapshot version it reads is pinned under
  ``<root>/_batches``; a replay reads the same labels and the same saved
  model, so it writes the same output;
* the merged snapshot carries the batch id in its name, so snapshot and stamp
  are one commit; a replay that finds it does not merge again;
* a retrained model is saved under the version it was trained on and is used
  from the next batch on; a replay writes the same files again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TagConfig
from ..operators import labels as L
from ..plans.state import build_state
from ..plans.tagging import batch_output, stored_predictions, tag_batch_results
from ..plans.workflow import load_state, maybe_retrain
from ..session import cut_lineage
from ..sources.store import LabelStore


def _pin(spark: SparkSession, store: LabelStore, batch_id: int) -> int | None:
    """The label version this batch reads: recorded once, before any work."""
    from ..sources.store import _fs
    path = f"{store.root}/_batches/{batch_id:012d}"
    fs, _ = _fs(spark, path)
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        return spark.read.schema("base long").json(path).first().base
    vs = [v for v in store.versions() if v != store.of_batch(batch_id)]
    base = vs[-1] if vs else None
    spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)
    return base


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, store: LabelStore,
                  out_path: str, cfg: TagConfig, retrain: bool = True,
                  order_col: str | None = None) -> None:
    """Tag one micro-batch.  Row order (it decides in-batch reuse) comes from
    ``order_col`` when the input carries one, else from the read order."""
    if batch.limit(1).count() == 0:
        return
    # row ids must stay fixed across the uses below, also after a lost
    # executor: materialise the numbered batch once
    rid = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
    rows = cut_lineage(batch.withColumn("_rid", rid))
    base = _pin(spark, store, batch_id)
    labels = store.load(base) if base is not None else L.empty_labels(spark)
    state = load_state(spark, store, cfg, base) if base is not None else build_state(labels, cfg)
    try:
        res = cut_lineage(tag_batch_results(rows, state, cfg, id_col="_rid"))
        out = (batch_output(rows, res, cfg, id_col="_rid").drop("_rid")
               .withColumn("batch_id", F.lit(batch_id).cast("long")))
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        version = store.of_batch(batch_id)
        if version is None:
            version = store.save_as_is(L.merge_predictions(labels, stored_predictions(res)), batch_id)
    finally:
        state.release()
    if retrain:
        new_state, _ = maybe_retrain(spark, store.load(version), cfg, store=store, version=version)
        if new_state is not None:
            new_state.release()


def start(spark: SparkSession, input_dir: str, schema: T.StructType, store: LabelStore,
          out_path: str, checkpoint: str, cfg: TagConfig = TagConfig(),
          available_now: bool = True, retrain: bool = True, order_col: str | None = None):
    """Start the stream; with ``available_now`` it processes what is there
    and stops (call ``awaitTermination``)."""
    src = (spark.readStream.schema(schema).option("header", True).option("multiLine", True)
           .option("escape", '"').csv(input_dir))
    w = (src.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: process_batch(spark, df, bid, store, out_path, cfg, retrain, order_col)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
