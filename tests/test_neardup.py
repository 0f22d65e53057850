import random

from shelfsort.functions.fuzz import token_sort_ratio_py
from shelfsort.operators.neardup import leaders
from refmodels import leaders_sequential


def test_leaders_equal_sequential_loop(spark):
    rnd = random.Random(2)
    vocab = ["ab", "abc", "abd", "x", "xy", "abcd", "b"]
    for trial in range(3):
        names = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
        exp = leaders_sequential(names, 92.0, token_sort_ratio_py)
        firsts = {}
        for i, n in enumerate(names):
            firsts.setdefault(n, i)
        df = spark.createDataFrame([(n, i) for n, i in firsts.items()], "name string, ord long")
        res = {r.ord: r.leader_ord for r in leaders(df, 92.0).collect()}
        for i, n in enumerate(names):
            f = firsts[n]
            if i == f:
                assert res[f] == exp[i], (trial, i, n)
            else:  # later duplicates reuse the first copy's leader, or the first copy itself
                lead = res[f] if res[f] is not None else f
                assert exp[i] == lead, (trial, i, n)


def _check(spark, names, threshold=92.0, few_pairs=2_000_000):
    exp = leaders_sequential(names, threshold, token_sort_ratio_py)
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    rows = leaders(df, threshold, few_pairs).collect()
    assert len(rows) == len(names)          # every row comes out
    res = {r.ord: r.leader_ord for r in rows}
    assert res == {i: exp[i] for i in range(len(names))}


def test_long_chain_keeps_every_row(spark):
    # each name is near its neighbours only
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = [base[i:] + base[:i] for i in range(0, 30)]
    _check(spark, names)
    _check(spark, names, few_pairs=0)


def test_dense_cluster_and_equal_tokens(spark):
    names = [f"imported sparkling lemonade bottle number {i}" for i in range(120)]
    names += [f"number {i} bottle lemonade sparkling imported" for i in range(0, 40)]
    names += ["", "x", "y", "x y", "y x"]
    _check(spark, names)
    _check(spark, names, few_pairs=0)       # thinned out in rounds
