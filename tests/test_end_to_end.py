from pyspark.sql import functions as F

from shelfsort.config import TagConfig
from shelfsort.plans.state import build_state
from shelfsort.plans.tagging import review_flag, tag, tag_batch_results
from shelfsort.workloads import FIXTURE_NAMES

# FIXTURES §4: category, conf, source, sub-category, sub conf, sub source, review
GOLDEN = [
    ("Beer", 0.9, "keyword", "Classic Lager", 0.92, "keyword", "NO"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.1685, "fallback", "YES"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.2265, "fallback", "YES"),
    ("Non-alcoholic Beer", 0.9, "keyword", "Non-alcoholic Beer", 0.2069, "fallback", "YES"),
    ("Non-alcoholic Beer", 1.0, "dataset", "Non-alcoholic Beer", 1.0, "exact", "NO"),
    ("Non-alcoholic Beer", 0.9, "keyword", "Non-alcoholic Beer", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.9, "keyword", "Hard Seltzers", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.9273, "vector", "Hard Seltzers", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.9, "keyword", "Cider", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.9095, "vector", "Cider", 0.92, "keyword", "NO"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.0455, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Variety Packs", 0.096, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Variety Packs", 0.018, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Variety Packs", 0.0744, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Craft Beer", 0.0669, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Variety Packs", 0.0175, "fallback", "YES"),
    ("Hard Beverage", 1.0, "dataset", "Ready to Drink", 1.0, "exact", "NO"),
    ("Beer", 0.0, "fallback", "Craft Beer", 0.0, "fallback", "YES"),
    ("Beer", 0.0, "fallback", "Light Lager", 0.92, "keyword", "YES"),
    ("Beer", 0.0, "fallback", "Light Lager", 0.1211, "fallback", "YES"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.8889, "fuzzy", "NO"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.2914, "fallback", "YES"),
    ("Hard Beverage", 1.0, "dataset", "Hard Seltzers", 1.0, "exact", "NO"),
    ("Beer", 0.96, "fuzzy", "Variety Packs", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.88, "fuzzy", "Ready to Drink", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.9787, "fuzzy", "Flavored Hard Beverages", 0.92, "keyword", "NO"),
    ("Hard Beverage", 0.8548, "vector", "Hard Seltzers", 0.92, "keyword", "NO"),
    ("Beer", 0.0, "fallback", "Light Lager", 0.92, "keyword", "YES"),
    ("Beer", 0.9, "keyword", "Craft Beer", 0.92, "keyword", "NO"),
]


def test_fixture_table(spark, seed_labels):
    cfg = TagConfig(use_ml=False)
    st = build_state(seed_labels, cfg)
    df = spark.createDataFrame(list(enumerate(FIXTURE_NAMES)), "row_id long, product_name string")
    rows = {r.row_id: r for r in tag(df, st, cfg).withColumn("review", review_flag(cfg)).collect()}
    for i, g in enumerate(GOLDEN):
        r = rows[i]
        got = (r.category, round(r.confidence, 4), r.source, r.predicted_sub_category,
               round(r.sub_confidence, 4), r.sub_source, r.review)
        assert got == g, (FIXTURE_NAMES[i], got, g)
    assert rows[7].steps_tried == ["dataset_exact", "fuzzy", "vector"]
    assert rows[0].steps_tried == ["dataset_exact"]
    assert rows[11].steps_tried[-1] == "fallback" and rows[11].low_confidence


def test_batch_reuse_case(spark, seed_labels):
    """FIXTURES §5: rows 2 and 3 reuse row 1's category as batch_cache."""
    cfg = TagConfig(use_ml=False)
    st = build_state(seed_labels, cfg, with_index=False)
    b = spark.createDataFrame([(0, "Foo Bar"), (1, "Foo Bar"), (2, "Bar Foo")], "row_id long, product_name string")
    rows = sorted(tag_batch_results(b, st, cfg).withColumn("review", review_flag(cfg)).collect(),
                  key=lambda r: r.row_id)
    assert rows[0].source == "fallback"
    assert [r.source for r in rows[1:]] == ["batch_cache", "batch_cache"]
    assert all(r.category == rows[0].category for r in rows)
    assert [r.review for r in rows] == ["YES"] * 3
    assert rows[1].steps_tried == ["batch_cache"] and not rows[1].low_confidence
