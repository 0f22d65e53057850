from shelfsort.operators.model import fit, predict, stratified_folds, train_metrics


def _folds_reference(labels, k):
    """Unshuffled stratified k-fold assignment (classes by first appearance)."""
    first = {}
    for i, y in enumerate(labels):
        first.setdefault(y, len(first))
    enc = [first[y] for y in labels]
    order = sorted(enc)
    ncls = len(first)
    alloc = [[sum(1 for p in range(f, len(order), k) if order[p] == c) for c in range(ncls)] for f in range(k)]
    folds = [None] * len(labels)
    for c in range(ncls):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, e in enumerate(enc) if e == c]
        for i, f in zip(idx, seq):
            folds[i] = f
    return folds


def test_stratified_folds(spark):
    labels = list("BAABBBCACBAABBCCAB")
    df = spark.createDataFrame([(i, "t", y, i) for i, y in enumerate(labels)], "rid long, text string, label string, ord long")
    got = {r.rid: r.fold for r in stratified_folds(df, 3).collect()}
    assert [got[i] for i in range(len(labels))] == _folds_reference(labels, 3)


def test_training_rules(spark):
    one = spark.createDataFrame([(0, "a b", "X", 0), (1, "c", "X", 1)], "rid long, text string, label string, ord long")
    assert fit(one) is None
    _, m = train_metrics(spark, one)
    assert m.first().status == "skipped"
    rows = [(i, t, y, i) for i, (t, y) in enumerate([("red lager beer", "Beer"), ("pale ale beer", "Beer"),
                                                    ("hard seltzer lime", "Hard"), ("hard cider", "Hard"),
                                                    ("zero alcohol", "NA")])]
    df = spark.createDataFrame(rows, "rid long, text string, label string, ord long")
    model, metrics = train_metrics(spark, df, max_iter=50)
    r = metrics.first()
    assert r.status == "trained" and r.samples == 5 and r.classes == ["Beer", "Hard", "NA"]
    assert r.cv_accuracy is None  # smallest class has one row
    q = spark.createDataFrame([(0, "amber lager beer"), (1, "hard seltzer")], "rid long, text string")
    p = {x.rid: x.ml_category for x in predict(model, q).collect()}
    assert p == {0: "Beer", 1: "Hard"}


def test_model_and_index_roundtrip(spark, tmp_path):
    from shelfsort.operators.tfidf import fit_index
    from shelfsort.plans.workflow import load_index, load_model, save_index, save_model
    rows = [(i, t, y, i) for i, (t, y) in enumerate([("red lager beer", "Beer"), ("pale ale beer", "Beer"),
                                                    ("hard seltzer lime", "Hard"), ("hard cider", "Hard")])]
    df = spark.createDataFrame(rows, "rid long, text string, label string, ord long")
    m = fit(df, max_iter=20)
    save_model(m, str(tmp_path / "m"))
    m2 = load_model(spark, str(tmp_path / "m"))
    q = spark.createDataFrame([(0, "amber lager beer")], "rid long, text string")
    assert predict(m, q).first().ml_category == predict(m2, q).first().ml_category == "Beer"
    docs = spark.createDataFrame([(i, i, t, "c", "s") for i, (_, t, _, _) in enumerate(rows)],
                                 "doc_id long, doc_ord long, text string, category string, predicted_sub_category string")
    idx = fit_index(docs, "text", 100)
    save_index(idx, str(tmp_path / "i"))
    idx2 = load_index(spark, str(tmp_path / "i"))
    assert idx2.n_docs == 4 and idx2.postings.count() == idx.postings.count()
