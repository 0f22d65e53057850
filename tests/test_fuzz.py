import random

from hypothesis import given, settings, strategies as st

from shelfsort.functions.fuzz import (indel_ratio, indel_ratio_py, lcs_length, token_set_ratio,
                                      token_set_ratio_py, token_sort_ratio, token_sort_ratio_py)


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@given(st.text(alphabet="abcé ", max_size=30), st.text(alphabet="abcé ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


@given(st.text(alphabet="ab c", max_size=15), st.text(alphabet="ab c", max_size=15))
@settings(max_examples=200, deadline=None)
def test_token_set_symmetric_and_bounded(a, b):
    x, y = token_set_ratio_py(a, b), token_set_ratio_py(b, a)
    assert abs(x - y) < 1e-9 and 0.0 <= x <= 100.0


def test_goldens(spark):
    pairs = [("quilmes cristal light", "quilmes cristal", 83.3333), ("caft beer", "craft beer", 94.7368),
             ("hard seltzer", "hard seltzers", 96.0), ("flavoured hard beverages", "flavored hard beverages", 97.8723)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(token_sort_ratio("a", "b")).collect()]
    for g, (_, _, e) in zip(got, pairs):
        assert round(g, 4) == e
    ts = spark.createDataFrame([("ipa craft", "craft"), ("quilmes cristal light", "light lager")], "a string, b string")
    assert [round(r[0], 2) for r in ts.select(token_set_ratio("a", "b")).collect()] == [100.0, 62.5]


def test_spark_matches_python_on_random_pairs(spark):
    rnd = random.Random(7)
    words = ["ab", "b", "abc", "ca", "c", "", "bb a"]
    pairs = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))),
              " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", token_sort_ratio("a", "b").alias("s"), token_set_ratio("a", "b").alias("t"),
                     indel_ratio("a", "b").alias("r")).collect()
    for r in rows:
        assert abs(r.s - token_sort_ratio_py(r.a, r.b)) < 1e-9
        assert abs(r.t - token_set_ratio_py(r.a, r.b)) < 1e-9
        assert abs(r.r - indel_ratio_py(r.a, r.b)) < 1e-9
