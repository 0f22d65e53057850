"""The batch job in one call."""
from shelfsort.config import TagConfig
from shelfsort.plans.workflow import tag_batch
from shelfsort.sources.store import LabelStore, read_batch_csv

CFG = TagConfig(use_ml=False)


def test_batch_job_writes_in_file_order_and_stores(spark, seed_labels, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    store.save_as_is(seed_labels)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,product_name\n1,Caft Beer\n2,"Hard Seltzers\n"\n')
    (tmp_path / "in" / "b.csv").write_text("id,product_name\n3,Craft Beer\n4,Caft Beer\n")
    out = tag_batch(spark, str(tmp_path / "in"), str(tmp_path / "dry"), store, CFG, store_results=False)
    assert store.versions() == [1] and out.count() == 4
    tag_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), store, CFG)
    rows = read_batch_csv(spark, str(tmp_path / "out")).orderBy("row_id").collect()
    assert [r.id for r in rows] == ["1", "2", "3", "4"]
    assert rows[0].category_source == "keyword" and rows[2].category_source in ("dataset", "batch_cache")
    assert rows[3].category_source == "batch_cache" and rows[3].needs_review == "YES"
    assert store.versions() == [1, 2]
    assert store.load().where("product_name = 'Caft Beer'").count() == 1
