import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from shelfsort.llm import lm as M  # noqa: E402
from shelfsort.llm import mixing as P  # noqa: E402


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", H.lower(t)) + ["\n"]


def plain_scores(items, weights, order):
    """doc_id -> contract columns, from dictionaries."""
    train = [tokens(t) for i, t in items if H.crc(i, 10) != 0]
    n = [Counter() for _ in range(order)]
    for x in train:
        x = ["<s>"] * (order - 1) + x
        for j in range(order - 1, len(x)):
            for k in range(order):
                n[k][tuple(x[j - k:j + 1])] += 1
    total, distinct = sum(n[0].values()), len(n[0])
    out = {}
    for i, t in items:
        x, base, score, known = tokens(t), 0.0, 0.0, 0
        y = ["<s>"] * (order - 1) + x
        for j in range(order - 1, len(y)):
            c = n[0][(y[j],)]
            known += c > 0
            base += math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
            p = [1 / (distinct + 1), c / total if total else 0.0]
            ctx = 0
            for k in range(1, order):
                h = tuple(y[j - k:j])
                ctx = len(train) if set(h) == {"<s>"} else n[k - 1][h]
                p.append(n[k][tuple(y[j - k:j + 1])] / ctx if ctx else 0.0)
            b = 0 if not ctx else 1 + min(int(math.log2(ctx)), M.BUCKETS - 2)
            score += math.log10(max(1e-300, float(np.dot(weights[b], p))))
        out[i] = (H.crc(i, 10) == 0, len(x), known, total, base, score)
    return out


def texts(n, seed=1):
    r = random.Random(seed)
    return [H.prose(i, r.randrange(0, 120), 150) for i in range(n)] + [None, "", " \n", "A a A", "once " * 3000]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_counts(spark, monkeypatch, order):
    seen = []
    learn = M.learn_weights
    monkeypatch.setattr(M, "learn_weights", lambda *a: seen.append(learn(*a)) or seen[-1])
    t = texts(150)
    docs = H.documents(spark, t).repartition(4)
    out = M.score(docs, order=order, block_tokens=900, range_tokens=3000)
    got = H.rows(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = plain_scores(list(enumerate(t)), seen[0], order)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9, abs=1e-9)
    assert np.allclose(seen[0].sum(1), 1) and (seen[0] > 0).all()


def test_em_finds_the_mixture():
    r = np.random.default_rng(1)
    # Tokens that the highest level explains well in bucket 5 and not at all in bucket 2.
    cells = [(5, 20, 40, 110, 900), (5, 20, 90, -1, 100), (2, 20, 60, -1, 500)]
    w = M.learn_weights(cells, 3)
    assert w[5, 2] > 0.8 and w[2, 2] < 0.01 and w[2, 1] > 0.9 and r is not None
    assert np.allclose(M.learn_weights([], 3), 1 / 3)


def test_histogram_unfolds():
    folded = np.array([(5 * M.CELLS + 41) * M.CELLS + 111, (2 * M.CELLS + 61) * M.CELLS])
    assert M.unfold(folded, np.array([900, 500]), 0.01, 3).tolist() == [[5, 100, 40, 110, 900], [2, 100, 60, -1, 500]]


def test_packed_keys_round_trip():
    r = np.random.default_rng(2)
    keys = np.sort(r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    for k in (keys, keys[::-1], keys[:1], keys[:0]):
        assert (M.unpack_keys(M.pack_keys(k)) == k).all()
    assert M.key_bits(0) >= M.SPARE_BITS and M.key_bits(1 << 50) == 64


def test_better_than_the_base_on_held_out_text(spark):
    r = random.Random(8)
    follow = {i: [r.randrange(200) for _ in range(3)] for i in range(200)}

    def text():
        w, out = r.randrange(200), []
        for _ in range(80):
            out.append(f"v{w}")
            w = r.choice(follow[w])
        return " ".join(out)
    out = M.score(H.documents(spark, [text() for _ in range(400)])).collect()
    held = [x for x in out if x.held_out]
    assert held and sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)


def test_lm_on_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, None, 2)], "doc_id bigint, text string, block int")
    out = M.score(df).collect()
    assert sorted((x.n_tokens, x.doc_id) for x in out if x.doc_id) == [(1, 3)] and len(out) == 3
    assert M.score(df.limit(0)).count() == 0
    held = [i for i in range(200) if H.crc(i, 10) == 0][:3]
    only = spark.createDataFrame([(i, "x y") for i in held], "doc_id bigint, text string")
    assert {(x.n_known, x.train_tokens) for x in M.score(only).collect()} == {(0, 0)}


def poisson_inverse(rate, u):
    k, p = 0, math.exp(-rate)
    s = p
    while s <= u and k < 10_000:
        k += 1
        p *= rate / k
        s += p
    return k


def copies(doc_id, rate, seed=17):
    from hashlib import md5
    parts = max(1, math.ceil(rate / P.MAX_RATE))
    return sum(poisson_inverse(rate / parts, int(md5(f"mix{seed}:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52)
               for j in range(1, parts + 1))


def test_mixing_equals_plain_inversion(spark):
    docs = H.documents(spark, [f"t{i}" for i in range(600)], source=lambda i: "big" if i < 400 else None if i < 500 else "c").repartition(3)
    weights = spark.createDataFrame([("big", 1.0), (None, 2.0), ("c", 40.0), ("nobody", 5.0)], "source string, weight double")
    out = P.mix(docs, weights, rows_out=4300.0).collect()
    n = Counter(r.doc_id for r in out)
    rate = {"big": 100 / 400, None: 200 / 100, "c": 4000 / 100}
    want = {i: copies(i, rate["big" if i < 400 else None if i < 500 else "c"]) for i in range(600)}
    assert {i: n.get(i, 0) for i in range(600)} == want
    assert abs(len(out) - 4300) < 250
    for i in range(600):
        assert sorted(r.copy for r in out if r.doc_id == i) == list(range(want[i])) or i % 50
    order = [r.mix_order for r in out]
    assert order == sorted(order) and [r.doc_id for r in out][:50] != sorted(r.doc_id for r in out)[:50]


def test_mixing_defaults_and_odd_tables(spark):
    df = spark.createDataFrame([(i % 50, None, "a" if i < 90 else "b", 7, "x") for i in range(100)],
                               "doc_id bigint, text string, source string, copy int, mix_order string")
    out = P.mix(df)
    assert out.columns == [*df.columns, "_copy", "_mix_order"]
    n = Counter(r.source for r in out.collect())
    assert 40 < n["a"] < 110 and 10 < n["b"] < 45  # 75 and 25 are expected
    assert P.mix(df.limit(0)).count() == 0
    none = spark.createDataFrame([("a", 0.0), ("b", None)], "source string, weight double")
    assert P.mix(df, none).count() == 0
    assert P.mix(spark.createDataFrame([(None, "t", None)], "doc_id bigint, text string, source string"), rows_out=9.0).count() == copies("null", 9.0)


def test_mixing_runs_no_python(spark):
    plan = P.mix(H.documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
