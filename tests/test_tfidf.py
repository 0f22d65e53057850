import random

import pytest
from pyspark.sql import functions as F

from shelfsort.config import DEFAULT_SEEDS
from shelfsort.operators.tfidf import fit_index, in_corpus_best, vector_match, vector_topk
from refmodels import cos, refit_best, tfidf_fit, tfidf_vec

SEED_NAMES = [s for s, _ in DEFAULT_SEEDS]


def _index(spark, texts, max_features=None):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, doc_ord long, text string")
    return fit_index(docs, "text", max_features)


def test_index_cosine_goldens(spark):
    idx = _index(spark, SEED_NAMES, 20000)
    q = spark.createDataFrame([("Caft Beer",), ("IPA Craft",), ("Hard Seltzer",), ("White Claw Hard Seltzers",)], "qid string")
    q = q.withColumn("text", F.col("qid"))
    top = {r.qid: (r.doc_id, round(r.score, 4)) for r in vector_topk(q, "text", idx, 1).collect()}
    assert top["Caft Beer"] == (0, 0.7927)
    assert top["IPA Craft"] == (0, 0.7924)
    assert top["Hard Seltzer"] == (5, 0.8951)
    assert top["White Claw Hard Seltzers"] == (5, 0.9273)
    hits = {r.qid: r.doc_id for r in vector_match(q, "text", idx, 0.80).collect()}
    assert hits == {"Hard Seltzer": 5, "White Claw Hard Seltzers": 5}


def test_vector_match_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["red", "ring", "bolt", "gear", "blue", "hard", "seltzer", "lager", "ale", "x"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    queries = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    idx = _index(spark, docs, 30)
    idf = tfidf_fit(docs, 30)
    dv = [tfidf_vec(t, idf) for t in docs]
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, text string")
    for t in (0.5, 0.8):
        got = {r.qid: (r.doc_id, round(r.score, 9)) for r in vector_match(q, "text", idx, t).collect()}
        exp = {}
        for i, text in enumerate(queries):
            qv = tfidf_vec(text, idf)
            sc = [cos(qv, v) for v in dv]
            b = max(range(len(sc)), key=lambda j: (round(sc[j], 12), -j))
            if sc[b] >= t:
                exp[i] = (b, round(sc[b], 9))
        assert got == exp


def test_in_corpus_goldens_and_refit(spark):
    beer = SEED_NAMES[:4]
    hard = SEED_NAMES[4:8]
    corpus = [("beer", i, i, t) for i, t in enumerate(beer)] + [("hard", 10 + i, 10 + i, t) for i, t in enumerate(hard)]
    c = spark.createDataFrame(corpus, "grp string, doc_id long, doc_ord long, text string")
    qs = [("q1", "beer", "Caft Beer"), ("q2", "hard", "Seltzers"), ("q3", "beer", "Energy Drinks"),
          ("q4", "hard", "zzz"), ("q5", "beer", "Light Lager Light")]
    q = spark.createDataFrame(qs, "qid string, grp string, text string")
    got = {r.qid: (r.doc_id, r.score) for r in in_corpus_best(q, c).collect()}
    assert got["q1"][0] == 0 and round(got["q1"][1], 4) == 0.6301
    assert got["q2"][0] == 11 and round(got["q2"][1], 4) == 0.8117
    for qid, grp, text in qs:
        docs = beer if grp == "beer" else hard
        bi, bs = refit_best(text, docs)
        off = 0 if grp == "beer" else 10
        assert got[qid][0] == off + bi
        assert abs(got[qid][1] - bs) < 1e-12


def _all_cosines(index, queries):
    from shelfsort.operators.tfidf import query_vectors
    q = query_vectors(queries, "text", index).select("qid", "gram", F.col("w").alias("wq"))
    d = index.postings.select("doc_id", "gram", F.col("w").alias("wd"))
    out = {}
    for r in q.join(d, "gram").groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("s")).collect():
        out.setdefault(r.qid, []).append((-round(r.s, 12), r.doc_id))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("probe,far", [(1, 0.0), (16, 0.0), (16, 0.35), (16, 2.0)])
def test_topk_equals_all_pairs(spark, probe, far):
    rnd = random.Random(9)
    words = ["red", "ring", "bolt", "gear", "blue", "hard", "seltzer", "lager", "ale", "x", "redd", "rings"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(80)] + ["", "zebra", "zebra"]
    queries = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(50)] + ["zebra", "", "qqq"]
    idx = _index(spark, docs, 60)
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, text string")
    want = _all_cosines(idx, q)
    got = {}
    for r in vector_topk(q, "text", idx, 5, probe=probe, far=far).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-round(r.score, 12), r.doc_id))
    assert got == {k: v[:5] for k, v in want.items()} and len(got) > 45


def test_topk_scores_few_pairs(spark):
    """1,600 names, 8 brands of each: pairs scored, against all that share a gram."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    base = [" ".join(rnd.sample(words, 3)) for _ in range(200)]
    docs = [f"{b} Brand#{n}" for b in base for n in rnd.sample(range(11, 56), 8)]
    idx = _index(spark, docs, 20_000)
    q = spark.createDataFrame([(i, t.replace("Brand#", "Brand ")) for i, t in enumerate(docs[::8])], "qid long, text string")
    stats = {}
    got = {}
    for r in vector_topk(q, "text", idx, 5, probe=256, far=0.0, stats=stats).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-round(r.score, 12), r.doc_id))
    want = _all_cosines(idx, q)
    assert got == {k: v[:5] for k, v in want.items()}
    assert stats["far"] == 0 and stats["pairs"] * 5 < sum(map(len, want.values())), (stats, sum(map(len, want.values())))


@pytest.mark.parametrize("values", [
    [5] * 40, list(range(1, 60)), [1] * 30 + [70_000] * 3 + [(1 << 33) + i % 3 for i in range(20)] + [1 << 62],
    [(1 << 16) - 1, 1 << 16, (1 << 16) + 1] * 9, [1, 0, 0, 3]])
def test_vocabulary_cap_equals_a_full_sort(spark, values):
    from shelfsort.operators.tfidf import _value_at_rank, vocabulary
    rows = [(f"g{(i * 37) % 101:03d}", v) for i, v in enumerate(values)]
    counts = spark.createDataFrame(rows, "gram string, cnt bigint").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in {1, len(rows) // 2, len(rows) - 1}:
        cut, above, ties = _value_at_rank(counts, "cnt", k)
        assert cut == order[k - 1][1]
        assert above == sum(v > cut for v in values) and ties == values.count(cut)
    for k in (len(rows) // 2, 1000):
        got = {(r.gram, r.tf) for r in vocabulary(counts, k).collect()}
        assert got == set(order[:k])
    assert vocabulary(counts.limit(0), 3).count() == 0
