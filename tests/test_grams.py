import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfsort.functions import grams as G
from shelfsort.operators.tfidf import doc_grams, gram_stats, gram_texts


def _flat(g):
    return sorted((o, g.names[i], n) for o, i, n in zip(g.owner.tolist(), g.gram.tolist(), g.cnt.tolist()))


@pytest.mark.parametrize("alphabet", ["ab", "xyé\x00一", "".join(map(chr, range(0x4e00, 0x5000))) + "\U0001F600"])
@pytest.mark.parametrize("step", [1 << 20, 17])
def test_count_grams_equals_counting_words(monkeypatch, alphabet, step):
    monkeypatch.setattr(G, "STEP_CHARS", step)
    r = random.Random(step)
    texts = [" ".join("".join(r.choices(alphabet, k=r.randint(1, 7))) for _ in range(r.randint(0, 30))) for _ in range(20)] + ["", "a", ""]
    assert _flat(G.count_grams(texts)) == _flat(G._one_by_one(texts))


def test_a_key_with_much_text_is_counted_in_parts():
    rows = [(1, "aa b"), (2, "aa"), (2, "aa"), (2, ""), (2, "c"), (3, "c c"), (None, None)]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "t": t} for i, t in rows[:3]]), pa.RecordBatch.from_pylist([{"id": i, "t": t} for i, t in rows[3:]])]

    def all_of(most):
        out, n = {}, {}
        for own, g in G.steps(iter(batches), 1, most):
            for o, name, c in _flat(g):
                out[own[o][0][0], name] = c
            n.update({x[0][0]: len(x) for x in own})
        return out, n
    want, n = all_of(1 << 20)
    assert n == {1: 1, 2: 4, 3: 1, None: 1} and want[2, "aa"] == 2 and want[2, " c"] == 1
    for most in (1, 2, 3, 5):
        assert all_of(most) == (want, n)


def test_gram_stats_equal_counts_by_row_and_move_no_grams(spark):
    r = random.Random(3)
    rows = [(i % 17 if i % 5 else None, " ".join(r.choices(["Red", "ale", "İx", "", " beer\t"], k=r.randint(0, 6))) if i % 7 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(x.gram, x.tf, x.df) for x in doc_grams(docs, ["doc_id"], "text").groupBy("gram").agg(
        F.sum("cnt").alias("tf"), F.count(F.lit(1)).alias("df")).collect()}
    stats = gram_stats(gram_texts(docs, ["doc_id"], "text"), ["doc_id"])
    assert {(x.gram, x.tf, x.df) for x in stats.collect()} == want
    # a row of (id, gram) is never shuffled: 16 times the input before
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and "Exchange hashpartitioning(doc_id#" in plan
    assert not any("hashpartitioning(doc_id" in line and "gram" in line for line in plan.splitlines())
