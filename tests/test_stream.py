import os
import tempfile

from pyspark.sql import types as T

from shelfsort.config import TagConfig
from shelfsort.sources.store import LabelStore
from shelfsort.streaming.incremental import start


def test_stream_restart_applies_each_batch_once(spark, seed_labels):
    root = tempfile.mkdtemp(prefix="stream-test-", dir="/tmp")
    inp = os.path.join(root, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "a.csv"), "w") as f:
        f.write("product_id,product_name\n1,Caft Beer\n2,Hazy IPA Limited Edition\n3,Caft Beer\n")
    store = LabelStore(spark, os.path.join(root, "labels"))
    store.save_as_is(seed_labels)
    schema = T.StructType([T.StructField("product_id", T.StringType()), T.StructField("product_name", T.StringType())])
    cfg = TagConfig(use_ml=False)
    args = (spark, inp, schema, store, os.path.join(root, "out"), os.path.join(root, "ckpt"), cfg)
    start(*args, retrain=False).awaitTermination()
    v1 = store.versions()
    start(*args, retrain=False).awaitTermination()          # restart, nothing new
    assert store.versions() == v1
    with open(os.path.join(inp, "b.csv"), "w") as f:
        f.write("product_id,product_name\n4,White Claw Hard Seltzers\n")
    start(*args, retrain=False).awaitTermination()
    assert len(store.versions()) == len(v1) + 1
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == 4
    rows = {r.product_id: r for r in out.collect()}
    assert rows["3"].category_source == "batch_cache" and rows["1"].predicted_category == "Beer"
    labels = {r.product_name: r.source for r in store.load().collect()}
    assert labels["Caft Beer"] == "batch_cache" and labels["White Claw Hard Seltzers"] == "vector"
    assert labels["Craft Beer"] == "seed"
