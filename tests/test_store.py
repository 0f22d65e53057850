import random

from pyspark.sql import functions as F

from shelfsort.config import LABEL_SCHEMA
from shelfsort.operators import labels as L
from refmodels import append_prediction, apply_correction, save

COLS = ["product_name", "predicted_sub_category", "category", "source", "confidence", "sub_confidence", "corrected"]


def _df(spark, rows):
    data = [(r["product_name"], r["predicted_sub_category"], r["category"], r["source"], r["confidence"],
             r["sub_confidence"], None, r["corrected"], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LABEL_SCHEMA)


def _rows(df):
    return [tuple(r[c] for c in COLS) for r in df.orderBy("seq").collect()]


def _base(rnd):
    names = ["Foo", "foo", "Bar", "Baz", "Qux", "bar "]
    srcs = ["seed", "human", "ml", "keyword", "llm", "vector"]
    rows = [dict(product_name=rnd.choice(names), predicted_sub_category="s", category=rnd.choice("AB"),
                 source=rnd.choice(srcs), confidence=0.5, sub_confidence=0.5, corrected=False) for _ in range(6)]
    return save(rows)


def test_prediction_merge_equals_loop(spark):
    rnd = random.Random(11)
    for trial in range(4):
        table = _base(rnd)
        preds = [(rnd.choice(["foo", " Bar", "new", "NEW", "Qux", "Baz"]), rnd.choice("CDE"),
                  rnd.choice(["ml", "keyword", "batch_cache", "llm"]), round(rnd.random(), 3), "sub", 0.4)
                 for _ in range(6)]
        exp = table
        for p in preds:
            exp = append_prediction([dict(r) for r in exp], *p)
        pdf = spark.createDataFrame([(n, c, s, f, u, g, i) for i, (n, c, s, f, u, g) in enumerate(preds)],
                                    "product_name string, category string, source string, confidence double, "
                                    "predicted_sub_category string, sub_confidence double, ord long")
        got = L.merge_predictions(_df(spark, table), pdf)
        assert sorted(_rows(got), key=repr) == sorted([tuple(r[c] for c in COLS) for r in exp], key=repr), trial


def test_correction_merge_equals_loop(spark):
    rnd = random.Random(5)
    for trial in range(3):
        table = _base(rnd)
        corr = [(rnd.choice(["foo", "Bar", "brand new", "Brand New "]), rnd.choice(["X", "Y"])) for _ in range(4)]
        exp = table
        for n, c in corr:
            exp = apply_correction([dict(r) for r in exp], n, c)
        cdf = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(corr)],
                                    "product_name string, category string, ord long")
        got = L.merge_corrections(_df(spark, table), cdf)
        assert sorted(_rows(got), key=repr) == sorted([tuple(r[c] for c in COLS) for r in exp], key=repr), trial


def test_seed_insert_skips_existing_keys(spark, seed_labels):
    seeds = spark.createDataFrame([(" craft beer ", "Beer", 0), ("New One", "X", 1), ("new one", "Y", 2)],
                                  "sub_category string, category string, ord long")
    out = L.seed_insert(seed_labels, seeds)
    names = sorted(r.product_name for r in out.collect())
    assert "craft beer" not in names and names.count("New One") == 1 and len(names) == 10


def test_priority_cases(spark):
    rows = [dict(product_name="A", predicted_sub_category="", category="c", source=s, confidence=None,
                 sub_confidence=None, corrected=False) for s in ("keyword", "ml")]
    out = L.dedup_priority(_df(spark, rows)).collect()
    assert [r.source for r in out] == ["ml"]
    rows = [dict(product_name="A", predicted_sub_category="", category=c, source=s, confidence=None,
                 sub_confidence=None, corrected=False) for s, c in (("ml", "first"), ("vector", "second"))]
    t = L.training_rows(_df(spark, rows)).collect()
    assert [r.category for r in t] == ["first"]
