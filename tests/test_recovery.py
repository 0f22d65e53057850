"""Crashes, replays and repeated evaluation."""
import os

import pytest
from pyspark.sql import functions as F

from shelfsort.config import LABEL_SCHEMA, TagConfig
from shelfsort.functions.text import clean_name
from shelfsort.operators import labels as L
from shelfsort.operators.llm import merge_category_replies, merge_sub_replies, request_id
from shelfsort.operators.tfidf import fit_index, vector_match, vector_topk
from shelfsort.plans.state import build_state, index_docs
from shelfsort.plans.workflow import bootstrap, load_state, maybe_retrain, metrics_table
from shelfsort.session import build_session, ensure_checkpoint_dir
from shelfsort.sources.store import LabelStore, builtin_seeds, read_batch_csv, write_batch_csv
from shelfsort.streaming import incremental

CFG = TagConfig(use_ml=False)


def _batch(spark, names):
    return spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "product_id string, product_name string")


def _out(spark, path):
    return sorted((r.product_name, r.predicted_category, r.category_source, r.category_confidence)
                  for r in spark.read.parquet(path).collect())


def test_replayed_batch_gives_the_same_output_and_one_merge(spark, seed_labels, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    store.save_as_is(seed_labels)
    names = ["Caft Beer", "White Claw Hard Seltzers", "Hard Kombuchas Ginger"]
    out = str(tmp_path / "out")
    incremental.process_batch(spark, _batch(spark, names), 7, store, out, CFG, retrain=False)
    first, versions = _out(spark, out), store.versions()
    incremental.process_batch(spark, _batch(spark, names), 7, store, out, CFG, retrain=False)
    assert _out(spark, out) == first and store.versions() == versions
    assert not any(s == "dataset" for _, _, s, _ in first)
    assert store.of_batch(7) == versions[-1] and store.of_batch(8) is None


def test_crash_between_output_and_merge(spark, seed_labels, tmp_path, monkeypatch):
    store = LabelStore(spark, str(tmp_path / "labels"))
    store.save_as_is(seed_labels)
    out = str(tmp_path / "out")
    monkeypatch.setattr(LabelStore, "save_as_is", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        incremental.process_batch(spark, _batch(spark, ["Caft Beer"]), 0, store, out, CFG, retrain=False)
    monkeypatch.undo()
    first = _out(spark, out)
    incremental.process_batch(spark, _batch(spark, ["Caft Beer"]), 0, store, out, CFG, retrain=False)
    assert _out(spark, out) == first and len(store.versions()) == 2


def test_batches_release_what_they_cache(spark, seed_labels, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    store.save_as_is(seed_labels)
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    incremental.process_batch(spark, _batch(spark, ["Caft Beer"]), 0, store, str(tmp_path / "o"), CFG, retrain=False)
    before = kept()
    incremental.process_batch(spark, _batch(spark, ["Caft Bear"]), 1, store, str(tmp_path / "o"), CFG, retrain=False)
    assert kept() <= before


def test_half_written_snapshot_does_not_jam_the_store(spark, seed_labels, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    v = store.save_as_is(seed_labels)
    os.makedirs(tmp_path / "labels" / f"v{v + 1:06d}" / "_temporary")
    assert store.versions() == [v]
    nxt = store.save(seed_labels)
    assert nxt == v + 2 and store.versions() == [v, v + 2] and store.load().count() == seed_labels.count()


def test_saved_model_and_index_are_used_by_the_next_session(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    cfg = TagConfig(model_max_iter=20)
    state, metrics = bootstrap(spark, store, builtin_seeds(spark), cfg, with_cv=False)
    assert metrics.first().status == "trained"
    again = load_state(spark, store, cfg)
    assert again.model.classes == state.model.classes and again.index.n_docs == state.index.n_docs
    assert [(r.status, r.version) for r in metrics_table(spark, store).collect()] == [("trained", store.versions()[-1])]
    folder, = os.listdir(f"{store.root}/_trained")
    meta = spark.read.json(f"{store.root}/_trained/{folder}/index/meta_json")
    assert {"product_name", "predicted_sub_category", "category"} <= set(meta.columns)
    assert maybe_retrain(spark, L.empty_labels(spark), cfg)[1].first().status == "no_data"


def test_replayed_or_crashed_save_leaves_committed_state_alone(spark, tmp_path, monkeypatch):
    from shelfsort.plans import workflow
    store = LabelStore(spark, str(tmp_path / "labels"))
    cfg = TagConfig(model_max_iter=5)
    state, metrics = bootstrap(spark, store, builtin_seeds(spark), cfg, with_cv=False)
    version, trained = store.versions()[-1], f"{store.root}/_trained"
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(trained) for f in fs)
    workflow.save_state(state, metrics, store, version)
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(trained) for f in fs) == before
    # a crash half way through a save of the next version: the old state is loaded, a second try commits
    nxt = store.save(store.load())
    monkeypatch.setattr(workflow, "save_index", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        workflow.save_state(state, metrics, store, nxt)
    monkeypatch.undo()
    assert load_state(spark, store, cfg).model.classes == state.model.classes
    assert list(workflow._trained(spark, store)) == [version]
    workflow.save_state(state, metrics, store, nxt)
    assert sorted(workflow._trained(spark, store)) == [version, nxt]
    assert load_state(spark, store, cfg).index.n_docs == state.index.n_docs


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_copies_match_themselves_in_a_large_table(spark, coalesce):
    n = 60_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        seeds = spark.range(n, numPartitions=8).select(
            F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 12), F.lit(" ale")).alias("sub_category"),
            F.lit("Beer").alias("category"), F.col("id").alias("ord"))
        labels = L.seed_insert(L.empty_labels(spark), seeds)
        assert labels.select("seq").distinct().count() == n
        index = fit_index(index_docs(L.training_rows(labels)), "text", 20_000)
        q = seeds.where("ord % 300 = 0").select(F.col("sub_category").alias("qid"), F.col("sub_category").alias("text"))
        for got in (vector_match(q, "text", index, 0.8), vector_topk(q, "text", index, 1)):
            hit = got.join(index.meta, "doc_id").where(F.col("qid") == F.col("product_name"))
            assert hit.count() == 200
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_quotes_survive(spark, tmp_path):
    df = spark.createDataFrame([(0, '6" Pizza, large', 'a\\"b'), (1, "two\nlines", '""')], "row_id long, product_name string, x string")
    write_batch_csv(df, str(tmp_path / "o"))
    back = read_batch_csv(spark, str(tmp_path / "o")).orderBy("row_id").collect()
    assert [(r.product_name, r.x) for r in back] == [('6" Pizza, large', 'a\\"b'), ("two\nlines", '""')]


REPLIES = [
    ('{"category": "Beer", "confidence": 0.7}', ("Beer", 0.7)), ("{'category': 'Beer'}", None), ('{"category": null}', None),
    ('{"category": 5}', None), ('{"category": "Beer", "confidence": null}', None), ('{"category": "Beer"}', ("Beer", 0.5)),
    ('{"category": "beer ", "confidence": "0.25"}', ("Beer", 0.25)), ('{"category": "Beer", "confidence": "high"}', None),
    ('{"category": "Beer", "confidence": [1]}', None), ('{"category": "Beer", "confidence": true}', ("Beer", 1.0)),
    ('x {"category": "Beer"} {"category": "Wine"}', ("Beer", 0.5)), ('{"category": "Beer"', None), ("", None), (None, None),
    ('{"category": "Beer", "confidence": 1}', ("Beer", 1.0))]


def test_reply_cases(spark, seed_labels):
    st = build_state(seed_labels, CFG, with_index=False)
    names = spark.createDataFrame([(f"n{i}",) for i in range(len(REPLIES))], "name string")
    rep = spark.createDataFrame([(f"n{i}", r) for i, (r, _) in enumerate(REPLIES)], "name string, reply string").select(
        request_id("name").alias("request_id"), "reply")
    got = {r.name: (r.llm_cat, r.llm_conf) for r in merge_category_replies(names, rep, st).collect()}
    assert got == {f"n{i}": w for i, (_, w) in enumerate(REPLIES) if w}


def test_sub_reply_cases(spark, seed_labels):
    st = build_state(seed_labels, CFG, with_index=False)
    cases = ['{"sub_category": "craft beer"}', '{"sub_category": " New Thing "}', '{"sub_category": ""}', '{"sub_category": null}',
             '{"sub_category": 4}', '{"other": "x"}', "none"]
    pairs = spark.createDataFrame([(f"n{i}", "Beer") for i in range(len(cases))], "name string, category string")
    rep = spark.createDataFrame([(f"n{i}", "Beer", r) for i, r in enumerate(cases)], "name string, category string, reply string").select(
        request_id("name", "category").alias("request_id"), "reply")
    got = {r.name: r.llm_sub for r in merge_sub_replies(pairs, rep, st).collect()}
    assert got == {"n0": "Craft Beer", "n1": "New Thing"}


def test_running_session_is_used_as_it_is(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert build_session() is spark and spark.conf.get("spark.sql.shuffle.partitions") == "37"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_numbering_is_dense_and_ordered(spark):
    rows = [(f"p{i}", "s", "c", "ml" if i % 2 else "human", 0.5, 0.5, None, False, i * 10) for i in range(100)]
    out = L.dedup_priority(spark.createDataFrame(rows, LABEL_SCHEMA).repartition(7)).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(100)) and [r.source for r in out[:50]] == ["human"] * 50
    assert clean_name("product_name") is not None
