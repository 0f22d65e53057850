from pyspark.sql import functions as F

from shelfsort.operators import labels as L


def _labels(spark, rows):
    return spark.createDataFrame([(n, "s", c, src, 0.5, 0.5, None, False, i) for i, (n, c, src) in enumerate(rows)], L.LABEL_SCHEMA)


def test_merge_moves_a_name_once(spark, monkeypatch):
    """Rows meet by a digest of the name; nothing is dealt out by whole texts, and
    the merged rows are de-duplicated where they lie.  Names without a value
    (null) meet nobody, and are one row after the save."""
    labels = _labels(spark, [("Red Ale", "Old", "ml"), ("RED ALE", "Old", "ml"), ("Stout", "Seed", "seed"), (None, "x", "ml"), (None, "y", "human")])
    preds = spark.createDataFrame([(" red ale ", "New", 0), ("stout", "New", 1), ("Porter", "A", 2), ("porter ", "B", 3), (None, "N", 4)],
                                  "product_name string, category string, ord long").select(
        "product_name", "category", F.lit("ml").alias("source"), F.lit(0.9).alias("confidence"),
        F.lit("t").alias("predicted_sub_category"), F.lit(0.8).alias("sub_confidence"), "ord")
    plans = []
    number = L.dense_positions

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return number(df, *args)
    monkeypatch.setattr(L, "dense_positions", watched)
    got = {(r.product_name, r.category, r.source) for r in L.merge_predictions(labels, preds).collect()}
    assert got == {(None, "y", "human"), ("Stout", "Seed", "seed"), ("Red Ale", "New", "ml"), ("RED ALE", "New", "ml"), ("Porter", "B", "ml")}
    assert "hashpartitioning(product_name" not in plans[0] and "hashpartitioning(key#" in plans[0]
    assert not any("hashpartitioning" in line and "product_name" in line for line in plans[0].splitlines())
