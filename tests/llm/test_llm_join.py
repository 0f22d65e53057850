import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from pyspark.sql import functions as F

from shelfsort.llm import decontaminate as D  # noqa: E402
from shelfsort.llm import hashing, ngram_join as J  # noqa: E402
from shelfsort.llm.components import components  # noqa: E402


def corpus(seed, bases=12, copies=8):
    r = random.Random(seed)
    texts = []
    for b in range(bases):
        base = H.prose(seed * 100 + b, r.choice([5, 8, 20, 60, 200]))
        texts.append(base)
        texts += [H.edited(base, r.random(), r.choice([0, 1, 1, 2, 4])) for _ in range(r.randrange(copies))]
    texts += [None, "", " \n ", "one", "ONE", "one two", "one two three four", "a b c d e", "A b c d E f"] + ["hot copy of a text that repeats"] * 40
    texts.append("very long " + H.prose(9, 30_000, 5000))
    r.shuffle(texts)
    return texts


def test_word_hashes_split_like_the_contract():
    texts = ["", None, " a  b ", "A\x0bB\x85c", "é x", "a" * 5000, "x"]
    h, n = hashing.words(pa.array(texts))
    assert n.tolist() == [0, 0, 2, 2, 1, 1, 1]
    assert h[0] == hashing.words(pa.array(["A"]))[0][0] and len(set(h.tolist())) == 6  # a, b twice by case


def test_division_of_words_over_chunks(monkeypatch):
    text = pa.array([H.prose(1, 2000), "zz " * 50])
    want = hashing.words(text)[0]
    monkeypatch.setattr(hashing, "_CHUNK", 37)
    assert (hashing.words(text)[0] == want).all()


@pytest.mark.parametrize("seed,piece", [(1, 1024), (2, 1024), (3, 6)])
def test_components_equal_all_pairs(spark, seed, piece):
    texts = corpus(seed)
    docs = H.documents(spark, texts).repartition(6)
    got = H.rows(J.jaccard_components(docs, piece=piece), "doc_id", "n_shingles", "component_id")
    assert got == H.jaccard_components(list(enumerate(texts)))


@pytest.mark.parametrize("piece", [16, 1024])
def test_large_group_of_near_copies(spark, piece):
    base = H.prose(77, 150, 3000)
    texts = [H.edited(base, i, 3) for i in range(150)] + [H.prose(1000 + i, 100, 3000) for i in range(30)]
    got = H.rows(J.jaccard_components(H.documents(spark, texts).repartition(5), piece=piece), "doc_id", "n_shingles", "component_id")
    assert got == H.jaccard_components(list(enumerate(texts)))


def test_search_equals_brute_force():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(200)]
    index = J.Index(base)
    others = [np.unique(np.concatenate([s[1:], r.integers(0, 90, 2).astype(np.uint64)])) for s in base[:80]]
    for q in base + others:
        want = [i for i, s in enumerate(base) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.search(q, lambda m: np.ones(len(m), bool)).tolist()) == want


def test_join_on_empty_and_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 1), (4, "a b c d e f", 1), (7, None, 1)],
                               "doc_id bigint, text string, node int")
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert out == [(-1, 2, 4), (4, 2, 4), (4, 2, 4), (7, 0, 7)]
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000
    assert components(edges.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [(i, H.prose(500 + i, r.choice([1, 2, 5, 13, 14, 30]), 60)) for i in range(40)] + [(90, None), (91, "--"), (92, "W1"), (93, "w1")]
    items += [(94, items[3][1]), (95, "Éa b-c 'd' 7 8 9 k l m n o p q r s")]
    docs = []
    for i in range(120):
        t = H.prose(i, r.randrange(0, 80), 60)
        if r.random() < 0.5:
            x = r.choice(items)[1] or ""
            t = t[:20] + " " + x.upper().replace(" ", r.choice([" ", ", ", "\n"])) + " " + t[20:]
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, "..."), (503, "Éa b c d 7 8 9 k l m n o p"), (504, "éa b c d 7 8 9 k l m n o p")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = H.rows(D.decontaminate(d, b), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == H.contamination(docs, items)


def test_decontamination_without_one_word_items_and_on_empty_tables(spark):
    items = [(i, H.prose(i, 15, 40)) for i in range(5)]
    docs = [(1, items[0][1] + " tail"), (2, "none"), (None, items[1][1])]
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id bigint, text string, pos int, window string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert H.rows(D.decontaminate(d, b), *names) == H.contamination(docs, items)
    assert H.rows(D.decontaminate(d, b.limit(0)), *names) == H.contamination(docs, [])
    assert D.decontaminate(d.limit(0), b).count() == 0
    twice = D.decontaminate(d.unionByName(d), b)
    assert H.rows(twice, *names) == H.contamination(docs, items) and twice.count() == 6


def test_decontamination_of_many_equal_rows(spark):
    """Copies under one key are judged once: pairs of copies would be 100 million here."""
    item = H.prose(3, 30, 200)
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    d = spark.range(10_000, numPartitions=6).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(f"a {item} b").alias("text"))
    got = D.decontaminate(d, b).groupBy("doc_id", "n_words", "n_hit", "n_items", "contaminated").count().collect()
    want = H.contamination([(None, f"a {item} b")], [(1, item)])[None]
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated, r["count"]) for r in got] == [(*want[:3], want[4], 10_000)]


def test_decontamination_tells_texts_of_one_id_apart(spark):
    item = [f"w{i}" for i in range(13)]
    half = " ".join(item[:7] + ["x"] * 6), " ".join(["y"] * 6 + item[6:])  # the window only by both together
    texts = [(None, half[0]), (None, half[1]), (None, " ".join(item)), (None, "clean one"), (None, None),
             (8, half[0]), (8, half[1]), (8, "z " + " ".join(item)), (9, "clean too")]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = D.decontaminate(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), b).collect()
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(i, *H.contamination([(0, t)], [(1, " ".join(item))])[0]) for i, t in texts]
    key = lambda x: (x[0] or 0, x[1:])
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=key) == sorted(want, key=key)


def estimate(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_rounds_of_joins_do_not_swell_the_planners_estimate(spark):
    """A checkpoint that kept the product of its sides' sizes doubled that number's
    digits every round, until it filled the driver."""
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    label = components(path)
    assert estimate(label) < 1 << 64
    again = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")))
    assert estimate(again) < 1 << 64
    assert {(r.node, r.label) for r in again.collect()} == {(i, 0) for i in range(41)}


def test_a_checkpoint_without_its_estimate_keeps_rows_and_columns(spark):
    from shelfsort.session import cut_lineage
    wide = spark.range(50).withColumn("k", F.col("id") % 7)
    for _ in range(4):
        wide = cut_lineage(wide.join(wide.select("id", F.col("k").alias("k2")), "id").select("id", F.greatest("k", "k2").alias("k")))
    assert estimate(wide) < 1 << 64
    assert [f.simpleString() for f in wide.schema.fields] == ["id:bigint", "k:bigint"]
    assert sorted((r.id, r.k) for r in wide.collect()) == [(i, i % 7) for i in range(50)]
    assert sorted((r.id, r.n) for r in wide.join(wide.groupBy("k").count().toDF("k", "n"), "k").collect()) == [
        (i, 8 if i % 7 == 0 else 7) for i in range(50)]
