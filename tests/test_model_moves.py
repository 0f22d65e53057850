import threading

from shelfsort.operators import model as M

ROWS = [(i, t, y, i) for i, (t, y) in enumerate([("red lager beer", "Beer"), ("pale ale beer", "Beer"), ("hard seltzer lime", "Hard"), ("hard cider", "Hard")] * 3)]
SCHEMA = "rid long, text string, label string, ord long"


def test_no_row_a_text_and_gram_is_written(spark, monkeypatch):
    """The counts of all texts by gram were written before every fit (some 30 times the texts)."""
    written = []
    cut = M.cut_lineage

    def watched(df):
        written.append(set(df.columns))
        return cut(df)
    monkeypatch.setattr(M, "cut_lineage", watched)
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = M.fit(df, max_iter=5)
    M.predict(model, df.select("rid", "text")).count()
    assert written and not any({"rid", "gram"} <= c or {"rid", "idx"} <= c for c in written)


def test_training_runs_in_full_waves_and_folds_side_by_side(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cores = spark.sparkContext.defaultParallelism
    texts, waves = M._even(df, "label")
    assert waves == 1 and texts.rdd.getNumPartitions() == cores
    monkeypatch.setattr(M, "WAVE_BYTES", 20)
    texts, waves = M._even(df, "label")
    assert waves > 1 and texts.rdd.getNumPartitions() == cores * waves
    monkeypatch.setattr(M, "WAVE_BYTES", 64 << 20)
    pools = []
    pool = M.ThreadPool
    monkeypatch.setattr(M, "ThreadPool", lambda n: pools.append(n) or pool(n))
    assert M.cross_validate(df, max_iter=20) >= 0.5
    assert pools == [5]


def test_vectors_of_copies_and_rows_without_an_id(spark):
    """Texts of one rid count as one; a row without a rid has no features."""
    df = spark.createDataFrame([(1, "red ale"), (1, "red"), (None, "red ale"), (2, "zzz"), (3, None)], "rid long, text string")
    train = spark.createDataFrame([(9, "red ale"), (8, "red")], "rid long, text string")
    stats = M.gram_stats(M._texts(train), ["rid"])
    vocab, n = M._fit_vocab(stats, 2, 100)
    got = [(r.rid, r.features) for r in M._vectors(M._texts(df), vocab, n).collect()]
    one = [f for i, f in got if i == 1]
    assert len(got) == 5 and len(one) == 2 and one[0] == one[1] and abs(one[0].norm(2) - 1.0) < 1e-12
    assert all(f.numNonzeros() == 0 and f.size == n for i, f in got if i != 1)


def test_passes_over_a_small_table_run_in_few_tasks(spark, monkeypatch):
    """Every pass of the optimiser ran in a task a core, each with sums of all features and classes."""
    tasks = []

    class Watched(M.LogisticRegression):
        def fit(self, data):
            tasks.append(data.rdd.getNumPartitions())
            return super().fit(data)
    monkeypatch.setattr(M, "LogisticRegression", Watched)
    df = spark.createDataFrame(ROWS, SCHEMA)
    few = M.predict(M.fit(df, max_iter=20), df.select("rid", "text")).orderBy("rid").collect()
    monkeypatch.setattr(M, "PASS_BYTES", 100)      # the texts have 162 bytes
    M.fit(df, max_iter=20)
    monkeypatch.setattr(M, "PASS_BYTES", 1)
    many = M.predict(M.fit(df, max_iter=20), df.select("rid", "text")).orderBy("rid").collect()
    cores = spark.sparkContext.defaultParallelism
    assert tasks[0] == 1 and 1 < tasks[1] < cores and tasks[2] == cores
    assert len(few) == len(ROWS) and all(a.ml_category == b.ml_category and abs(a.ml_confidence - b.ml_confidence) < 1e-6 for a, b in zip(few, many))


def test_the_model_of_a_small_table_is_trained_beside_the_folds(spark, monkeypatch):
    """The model was trained before the folds, each waiting between iterations."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    alone = M.cross_validate(df, max_iter=20)
    both = threading.Barrier(2, timeout=60)
    fit, folds = M.fit, M.cross_validate
    monkeypatch.setattr(M, "fit", lambda *a: both.wait() + 1 and fit(*a))
    monkeypatch.setattr(M, "cross_validate", lambda *a: both.wait() + 1 and folds(*a))
    model, metrics = M.train_metrics(spark, df, max_iter=20)
    assert model.classes == ["Beer", "Hard"] and metrics.first().cv_accuracy == alone


def test_large_models_are_trained_one_by_one(spark, monkeypatch):
    """The optimisers of all folds were held by the driver at once, whatever the number of classes."""
    assert M._at_once(5, 1, 11, 10_000, "linear") == 5 and M._at_once(5, 2, 11, 10_000, "linear") == 1
    assert 1 < M._at_once(5, 1, 100, 10_000, "linear") < 5 and M._at_once(5, 1, 1000, 10_000, "linear") == 1
    assert M._at_once(5, 1, 1000, 10_000, "boosted") == 5
    order = []
    monkeypatch.setattr(M, "FITS_BYTES", 0)
    fit, folds = M.fit, M.cross_validate

    def noted(name, f):
        def run(*a):
            order.append(name)
            out = f(*a)
            order.append(name)
            return out
        return run
    monkeypatch.setattr(M, "fit", noted("fit", fit))
    monkeypatch.setattr(M, "cross_validate", noted("folds", folds))
    _, metrics = M.train_metrics(spark, spark.createDataFrame(ROWS, SCHEMA), max_iter=20)
    assert order == ["fit", "fit", "folds", "folds"] and metrics.first().cv_accuracy >= 0.5


def test_weights_are_sorted_only_when_out_of_place(spark, monkeypatch):
    """Counted grams lie in the vocabulary's order; sorting them again took a third of the weights' time."""
    import numpy as np
    from shelfsort.functions.grams import count_grams
    g = count_grams(["red lager beer", "hard cider", "", "é beer beer"])
    rows = [[(i,)] for i in range(4)]

    def weighed(names):
        vocab = spark.createDataFrame([(n, i, 1.0 + len(n)) for i, n in enumerate(names)], "gram string, idx long, idf double")
        owner, at, w = M._weights(vocab)(rows, g)
        return {(o, names[i]): x for o, i, x in zip(owner.tolist(), at.tolist(), w.tolist())}, list(zip(owner.tolist(), at.tolist()))

    backwards, places = weighed(sorted(g.names, reverse=True))
    assert places == sorted(places)
    monkeypatch.setattr(np, "lexsort", None)
    forwards, places = weighed(sorted(g.names))
    assert places == sorted(places) and forwards.keys() == backwards.keys()
    assert all(abs(forwards[k] - backwards[k]) < 1e-12 for k in forwards)
